"""Queries of the scalar functions (F01 to F69), over one awkward cell for each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import cells, parse, text
from quillgrid.plans import frames as D
from quillgrid.plans.registry import query

_M = D.duck(D.MESSY)
_TRIM = "regexp_replace(regexp_replace({x}, '^[\\s\\u00a0]+', ''), '[\\s\\u00a0]+$', '')".replace("\\u00a0", " ")


def tr(x: str) -> str:
    return _TRIM.replace("{x}", x)


def norm(c: str) -> str:
    t = tr(f"coalesce(CAST({c} AS VARCHAR), '')")
    return f"(CASE WHEN lower({t}) = 'nan' THEN '' ELSE {t} END)"


def phrase(c: str) -> str:
    return f"regexp_replace(lower({norm(c)}), '[\\s ]+', ' ', 'g')"


def multi(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({norm(c)}, '\\s*;\\s*'), lambda x: {tr('x')}), lambda x: x <> '')"


def ordered(lst: str) -> str:
    """Distinct, in order of first occurrence."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def phr(lst: str) -> str:
    one = f"list_filter(list_transform({lst}, lambda y: regexp_replace(lower({tr('y')}), '[\\s ]+', ' ', 'g')), lambda y: y <> '' AND y <> 'nan')"
    return ordered(one)


def lst(x: str) -> str:
    return f"array_to_string({x}, '|')"


UNI = f"regexp_extract_all({phrase('t')}, '[a-z0-9]+')"
_T, _B = D.text("flag"), "\\b"
_RAW, _CLEAN = tr("coalesce(answer, '')"), f"regexp_replace({tr(chr(99) + 'oalesce(answer, ' + repr('') + ')')}, '(?i)(step|field|phase)\\s*\\d+', '', 'g')"
_LONE = f"nullif(regexp_extract({_CLEAN}, '(?:^|[^0-9])(1|0)(?:[^0-9]|$)', 1), '')"
_EXPL = f"coalesce(nullif(regexp_extract({_RAW}, '(?:最终答案|最终结论|答案|结论)\\s*[:：是为]?\\s*([01])\\b', 1), ''), nullif(regexp_extract({_RAW}, '(?i)\"?(?:是否属于城市更新研究|is_urban_renewal)\"?\\s*[:=]\\s*\"?([01])\"?', 1), ''))"
_LINE = f"nullif(regexp_extract({_CLEAN}, '(?m)^\\s*([01])\\s*$', 1), '')"
_YES = f"regexp_matches({_RAW}, '(?i)\\b(yes|true)\\b')"
_LABEL = f"CASE WHEN {_RAW} = '' THEN '0' ELSE coalesce({_EXPL}, {_LINE}, {_LONE}, CASE WHEN {_YES} THEN '1' ELSE '0' END) END"
_WHY = f"CASE WHEN {_RAW} = '' THEN 'empty_text' WHEN {_EXPL} IS NOT NULL THEN 'explicit_answer_pattern' WHEN {_LINE} IS NOT NULL THEN 'single_digit_line' WHEN {_LONE} IS NOT NULL THEN 'fallback_first_digit' WHEN {_YES} THEN 'fallback_boolean_yes' ELSE 'no_label_detected' END"
_FIRST = "coalesce(list_filter(list_transform(string_split(coalesce(answer, ''), chr(10)), lambda x: " + tr("x") + "), lambda x: x <> '')[1], '')"
_PARTS = f"list_transform(string_split({_FIRST}, chr(9)), lambda x: {tr('x')})"
_TAB = f"CASE WHEN len({_PARTS}) >= 4 THEN ({_PARTS})[3] || '/' || ({_PARTS})[4] END"
_SENT = "concat_ws(' [SEP] ', nullif({a}, ''), nullif({b}, ''))"
_SIMPLE = f"coalesce({_LONE}, CASE WHEN {_YES} THEN '1' ELSE '0' END)"
NAMES = {"U3": "third", "N10": "tenth", "N2": "second"}
_DESC = f"regexp_replace(regexp_replace(lower({tr('coalesce(kw1, ' + repr('nan') + ')')}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"

#: name: (what Spark computes, the same in DuckDB); arrays are joined by "|".
ITEMS = {
    "f01_normalize_text": (lambda: text.normalize("t"), norm("t")),
    "f02_split_multi_value": (lambda: F.array_join(text.multi("kw1"), "|"), lst(multi("kw1"))),
    "f03_normalize_phrase": (lambda: text.phrase("t"), phrase("t")),
    "f04_unique_phrases": (lambda: F.array_join(text.phrases(text.multi("kw1")), "|"), lst(phr(multi("kw1")))),
    "f05_build_keywords": (lambda: text.keywords("kw1", "kw2"), f"array_to_string({phr(f'list_concat({multi(chr(107) + chr(119) + chr(49))}, {multi(chr(107) + chr(119) + chr(50))})')}, '; ')"),
    "f08_title_abstract_text": (lambda: text.joined(["t", "kw1"]), _SENT.replace("{a}", norm("t")).replace("{b}", norm("kw1"))),
    "f09_weighted_text": (lambda: text.weighted("kw1", "kw2"), f"array_to_string(list_filter([{norm('kw1')}, {norm('kw1')}, {norm('kw2')}, {norm('kw2')}, {norm('kw2')}], lambda x: x <> ''), ' ')"),
    "f10_combined_text": (lambda: text.joined(["t", "kw1", "kw2", "lang", "source"]), f"concat_ws(' [SEP] ', nullif({norm('t')}, ''), nullif({norm('kw1')}, ''), nullif({norm('kw2')}, ''), nullif({norm('lang')}, ''), nullif({norm('source')}, ''))"),
    "f11_build_key": (lambda: text.key("t"), f"regexp_replace(lower({tr('coalesce(t, ' + repr('nan') + ')')}), '[\\s ]+', ' ', 'g')"),
    "f12_normalize_binary": (lambda: cells.binary("flag"), D.binary("flag")),
    "f14_normalize_description": (lambda: cells.description("kw1"), _DESC.replace("{{", "{").replace("}}", "}")),
    "f17_theme_label": (lambda: cells.topic("label"), D.topic("label")),
    "f18_theme_group": (lambda: cells.family("label"), D.family("label")),
    "f19_is_present": (lambda: cells.is_present("t"), D.present("t")),
    "f20_is_cluster": (lambda: cells.is_cluster("flag"), D.clustered("flag")),
    "f21_numeric_flag": (lambda: cells.flag_number("flag"), D.flag("flag")),
    "f22_decided_prediction": (lambda: cells.decided("flag"), D.decided("flag")),
    "f23_binary_text": (lambda: cells.binary_text("flag"), f"CASE WHEN replace({_T}, '.0', '') IN ('0', '1') THEN replace({_T}, '.0', '') ELSE '' END"),
    "f24_binary_label": (lambda: F.when(cells.is_present("flag"), cells.binary_text("flag")).otherwise(""), f"CASE WHEN replace({_T}, '.0', '') IN ('0', '1') THEN replace({_T}, '.0', '') ELSE '' END"),
    "f25_spatial_flag": (lambda: cells.spatial_flag("flag"), f"CASE WHEN lower({_T}) IN ('1', '1.0', 'true', 'spatial') THEN 'Spatial' WHEN lower({_T}) IN ('0', '0.0', 'false', 'non-spatial', 'nonspatial', '') THEN 'Non-spatial' ELSE lower({_T}) END"),
    "f26_paper_id": (lambda: cells.paper_id(F.col("doc_id") % 1000, "kw1"), f"lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '_' || substr(regexp_replace({tr('regexp_replace(coalesce(kw1, ' + repr('') + '), ' + repr('[^a-zA-Z0-9_ -]') + ', ' + repr('') + ', ' + repr('g') + ')')}, '\\s+', '_', 'g'), 1, 50)"),
    "f27_topic_group": (lambda: F.when(cells.is_topic(cells.topic("label")), cells.family("label")).otherwise("unknown"), f"CASE WHEN {D.family('label')} = '' THEN 'unknown' ELSE {D.family('label')} END"),
    "f28_topic_name": (lambda: cells.looked_up(cells.topic("label"), NAMES, "Unknown"), f"CASE {D.topic('label')} WHEN 'U3' THEN 'third' WHEN 'N10' THEN 'tenth' WHEN 'N2' THEN 'second' ELSE 'Unknown' END"),
    "f31_topic_flag": (lambda: cells.topic_flag("label"), f"CASE {D.family('label')} WHEN 'urban' THEN '1' WHEN 'nonurban' THEN '0' ELSE '' END"),
    "f32_dedupe": (lambda: F.array_join(F.array_distinct(text.multi("kw1")), "|"), lst(ordered(multi("kw1")))),
    "f35_parse_answer": (lambda: parse.answer("answer")["label"], _LABEL),
    "f36_parse_answer_reason": (lambda: parse.answer("answer")["reason"], _WHY),
    "f37_simple_answer": (lambda: parse.simple_answer("answer"), _SIMPLE),
    "f38_tab_output": (lambda: F.concat_ws("/", parse.tabbed("answer")["level"], parse.tabbed("answer")["area"]), f"coalesce({_TAB}, '')"),
    "f39_two_fields": (lambda: F.coalesce(F.concat_ws("/", parse.two_fields("answer")["level"], parse.two_fields("answer")["area"]), F.lit("")), f"CASE WHEN len({_PARTS}) >= 2 THEN ({_PARTS})[1] || '/' || ({_PARTS})[2] ELSE '' END"),
    "f41_spatial_truth": (lambda: parse.is_spatial("flag"), f"lower({_T}) IN ('true', '1', '1.0', 'yes', 'y', 'spatial') OR coalesce(try_cast({_T} AS DOUBLE), 0) <> 0"),
    "f49_document_text": (lambda: F.concat_ws(" ", *(F.when(cells.is_present(c), cells.text_of(c)) for c in ("t", "kw1", "kw2"))), "concat_ws(' ', " + ", ".join(f"CASE WHEN {D.present(c)} THEN {tr('coalesce(' + c + ', ' + repr('') + ')')} END" for c in ("t", "kw1", "kw2")) + ")"),
    "f50_has_value": (lambda: cells.is_present("kw2"), D.present("kw2")),
    "f51_sha256": (lambda: text.digest("source"), "sha256(source)"),
    "f52_sigmoid": (lambda: F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0)), 9), "round(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 9)"),
    "f54_last_tabbed_line": (lambda: parse.last_tabbed_line("answer"), "coalesce(list_filter(string_split(coalesce(answer, ''), chr(10)), lambda x: contains(x, chr(9)))[-1], coalesce(answer, ''))"),
    "f55_keyword_tokens": (lambda: F.array_join(text.keyword_list("kw1"), "|"), lst(phr(multi("kw1")))),
    "f56_keywords_plus_tokens": (lambda: F.array_join(text.keyword_list("kw2"), "|"), lst(phr(multi("kw2")))),
    "f57_domain_tokens": (lambda: F.array_join(text.domains("kw1", "kw2"), "|"), lst(phr(f"list_concat({multi('kw1')}, {multi('kw2')})"))),
    "f59_is_topic": (lambda: cells.is_topic(cells.topic("label")), f"{D.family('label')} IN ('urban', 'nonurban')"),
    "f60_clean_text_field": (lambda: parse.clean_area("t"), f"CASE WHEN trim(lower({tr('coalesce(t, ' + repr('') + ')')}), ' .;:') IN ('', 'null', 'none', 'n/a', 'na', 'nan', 'not mentioned', 'not specified', 'unspecified', 'unknown') THEN 'Not mentioned' ELSE {tr('coalesce(t, ' + repr('') + ')')} END"),
    "f61_normalize_for_match": (lambda: parse.matched("t"), "lower(trim(regexp_replace(regexp_replace(coalesce(t, ''), '[‘’“”]', chr(39), 'g'), '\\s+', ' ', 'g')))"),
    "f63_has_named_anchor": (lambda: parse.has_anchor(F.coalesce("kw1", F.lit(""))), "len(list_filter(regexp_extract_all(coalesce(kw1, ''), '\\b[A-Z][A-Za-z-]+\\b'), lambda x: lower(x) NOT IN ('a', 'an', 'the', 'selected', 'local', 'urban', 'brownfield', 'ecologically', 'sensitive', 'contentious', 'case', 'study', 'city', 'site', 'area', 'municipality', 'neighborhood', 'neighbourhood', 'district', 'block', 'corridor', 'development', 'project'))) > 0"),
    "f66_lowered_document": (lambda: text.phrase(F.concat_ws(" ", text.normalize("t"), text.normalize("kw1"))), phrase(f"({norm('t')} || ' ' || {norm('kw1')})")),
    "f67_contains_anchor": (lambda: text.contains_any(text.phrase("t"), ["tion", "ung"]), f"contains({phrase('t')}, 'tion') OR contains({phrase('t')}, 'ung')"),
    "s09_name_tokens": (lambda: F.array_join(F.array_sort(text.word_set("source")), "|"), "array_to_string(list_sort(list_distinct(regexp_extract_all(lower(source), '[a-z0-9]+'))), '|')"),
}


def _register(name: str, make, sql: str) -> None:
    def run(spark, sf_dir):
        return D.spark_frame(spark, sf_dir, D.MESSY).select("doc_id", make().alias("value"))

    query(name, f"WITH m AS ({_M}) SELECT doc_id, {sql} AS value FROM m")(run)


for _n, (_f, _s) in ITEMS.items():
    _register(_n, _f, _s)


@query("f06_tokenize", f"WITH m AS ({_M}), u AS (SELECT doc_id, {UNI} AS u FROM m), p AS (SELECT doc_id, u, list_transform(list_zip(u[1:len(u) - 1], u[2:]), lambda x: x[1] || '_' || x[2]) AS p FROM u) SELECT doc_id, array_to_string(list_concat(u, p), '|') AS value FROM p")
def f06(spark, sf):
    return D.spark_frame(spark, sf, D.MESSY).select("doc_id", F.array_join(text.tokens("t"), "|").alias("value"))


