"""Queries over raw rows: text, parsing, sanitising, audit, names, feed and xG."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog import views
from touchline.catalog.registry import joined, query, r6
from touchline.functions import odds, text
from touchline.operators import audit, cleaning, feed_audit, findings, missing, names, priors, xg
from touchline.sources import writers

RAW = f"with r as ({views.RAW_SQL})"
_NUMBER = "case when regexp_matches(replace(trim({c}), ',', '.'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then cast(replace(trim({c}), ',', '.') as double) end"


def _odd(columns: tuple[str, ...]) -> str:
    values = [_NUMBER.format(c=f'"{c}"') for c in columns]
    return "coalesce(" + ", ".join(f"case when {v} > 1.01 then {v} end" for v in values) + ", null)"


# The derived rows have B365 columns only, so those are the preference lists in effect.
FACTS = RAW + f""", a as (select *, trim("HomeTeam") as ht, trim("AwayTeam") as at_,
    coalesce(try_strptime(trim("Date"), '%d/%m/%y'), try_strptime(trim("Date"), '%d/%m/%Y'), try_strptime(trim("Date"), '%Y-%m-%d'),
      try_strptime(trim("Date"), '%d-%m-%Y')) as ts,
    case upper(trim("FTR")) when 'H' then '1' when 'D' then 'X' when 'A' then '2' end as res, {_NUMBER.format(c='"FTHG"')} as hg, {_NUMBER.format(c='"FTAG"')} as ag,
    {_odd(("B365H",))} as o1, {_odd(("B365D",))} as ox, {_odd(("B365A",))} as o2,
    {_odd(("B365CH",))} as k1, {_odd(("B365CD",))} as kx, {_odd(("B365CA",))} as k2,
    {_odd(("B365CH", "B365H"))} as e1, {_odd(("B365CD", "B365D"))} as ex, {_odd(("B365CA", "B365A"))} as e2,
    trim(concat_ws('', "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HS", "AS", "HST", "AST", "HC", "B365H", "B365D", "B365A", "B365CH", "B365CD", "B365CA")) = '' as is_empty,
    trim(concat_ws('', "HS", "AS", "HST", "AST", "HC")) = '' as no_stats,
    trim(concat_ws('', "B365H", "B365D", "B365A", "B365CH", "B365CD", "B365CA")) = '' as no_odds from r),
f as (select *, cast(ts as date) as d, o1 is not null and ox is not null and o2 is not null as has_open, k1 is not null and kx is not null and k2 is not null as has_real,
    case when e1 is not null and ex is not null and e2 is not null then 1 / e1 + 1 / ex + 1 / e2 end as ovr from a),
x as (select *, not is_empty and d is not null and ht <> '' and at_ <> '' and hg is not null and ag is not null and res is not null as complete,
    case when is_empty then 'EMPTY_ROW' when trim("Date") <> '' and ht <> '' and at_ <> '' and trim("FTHG") <> '' and trim("FTAG") <> '' and trim("FTR") <> ''
        and no_stats and no_odds then 'ADMINISTRATIVE_CANDIDATE' when not has_open then 'MISSING_REQUIRED_ODDS' end as reason,
    case when is_empty then 'EMPTY_ROW' when d is null then 'INVALID_DATE' when ht = '' or at_ = '' then 'MISSING_MATCH_IDENTITY'
      when hg is null or ag is null then 'MISSING_GOALS' when res is null then 'MISSING_OR_INVALID_RESULT'
      when not has_open or ovr is null then 'MISSING_REQUIRED_ODDS' end as discard,
    not old and trim("HS") <> '' and trim("AS") <> '' and trim("HST") <> '' and trim("AST") <> '' as shots_ok from f)
"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.row_facts(views.raw_history(spark, sf))


@query("SRC1 SRC4 SRC5 SRC6 P1 P2 P3 P5 P6 P7 U1", FACTS + """
select _line as match_id, d as date, ht as home, at_ as away, cast(hg as int) as fthg, cast(ag as int) as ftag, res as result,
  round(e1, 6) as odd_1, round(ex, 6) as odd_x, round(e2, 6) as odd_2, round(o1, 6) as open_odd_1, round(ox, 6) as open_odd_x, round(o2, 6) as open_odd_2,
  _division as division, _season as season, _source_file as source_file
from x where d is not null and hg is not null and ag is not null and res is not null and ovr is not null and has_open""")
def typed_history(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_history(spark, sf).withColumn("match_id", F.col("_line"))
    typed = cleaning.require_known_divisions(cleaning.typed_matches(raw))
    return typed.select(
        "match_id", "date", "home", "away", F.col("FTHG").alias("fthg"), F.col("FTAG").alias("ftag"), "result",
        *[r6(c) for c in ("odd_1", "odd_x", "odd_2", "open_odd_1", "open_odd_x", "open_odd_2")], "division", "season", "source_file",
    )


@query("P4 P8 P9 P10 P11 P12 P13 P14 P15 P16 P17 P18 P19 P20 SRC2", FACTS + """
select _line as line, _source_file as source_file, _division as division, _season as season, reason as motivo_exclusion,
  case when ht = 'Leonesa' then 'Cultural Leonesa' else "HomeTeam" end as home_team, case when ht = 'Leonesa' then 'Leonesa' end as home_team_original,
  case when reason is null then has_real end as tiene_cierre_real, case when reason is null then coalesce(shots_ok, false) end as tiene_tiros,
  case when reason is null then round(ovr, 6) end as overround, case when reason is null then coalesce(ovr < 1.0 or ovr > 1.4, false) end as cuota_sospechosa,
  case when reason is null and has_real then round((1 / e1) / ovr - (1 / o1) / (1 / o1 + 1 / ox + 1 / o2), 6) end as market_move_1,
  concat_ws('|', case when ht = 'Leonesa' then 'ALIAS_APPLIED:Leonesa->Cultural Leonesa' end, case when reason is not null then concat('EXCLUDED:', reason) end,
    case when reason is null and not has_real then 'MARKET_MOVE_AS_NAN_NO_REAL_CLOSE' end,
    case when reason is null and (ovr < 1.0 or ovr > 1.4) then 'ODDS_OVERROUND_OUT_OF_RANGE' end,
    case when reason is null and old then 'SHOTS_SCHEMA_MISSING' when reason is null and not shots_ok then 'SHOTS_VALUES_INCOMPLETE' end) as transformaciones
from x""")
def sanitised_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.sanitise(views.raw_history(spark, sf))
    return rows.select(
        F.col("_line").alias("line"), "source_file", "division", "season", "motivo_exclusion", F.col("HomeTeam").alias("home_team"),
        "home_team_original", "tiene_cierre_real", "tiene_tiros", r6("overround"), "cuota_sospechosa", r6("market_move_1"),
        joined("transformaciones", "transformaciones"),
    )


@query("A4 SNK4", FACTS + """
select count(*) as input_rows, cast(sum(case when reason is null then 1 else 0 end) as bigint) as output_rows,
  cast(sum(case when reason is not null then 1 else 0 end) as bigint) as excluded_rows,
  cast(sum(case when reason is null and has_real then 1 else 0 end) as bigint) as has_real_close,
  cast(sum(case when reason is null and shots_ok then 1 else 0 end) as bigint) as has_shots,
  cast(sum(case when reason is null and (ovr < 1.0 or ovr > 1.4) then 1 else 0 end) as bigint) as suspicious_odds,
  cast(sum(case when reason is null and ht = 'Leonesa' then 1 else 0 end) as bigint) as alias_applied,
  round(100.0 * sum(case when reason is null and has_real then 1 else 0 end) / sum(case when reason is null then 1 else 0 end), 2) as has_real_close_pct,
  round(100.0 * sum(case when reason is null and shots_ok then 1 else 0 end) / sum(case when reason is null then 1 else 0 end), 2) as has_shots_pct
from x""")
def sanitise_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.sanitise_stats(cleaning.sanitise(views.raw_history(spark, sf)))


@query("A4", FACTS + """
select 'kept' as kind, concat(_division, '/', _season) as item, count(*) as rows from x where reason is null group by _division, _season
union all select 'excluded', reason, count(*) from x where reason is not null group by reason""")
def sanitise_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.breakdown(cleaning.sanitise(views.raw_history(spark, sf)))


@query("SNK1 SNK4 U1")
def clean_output_rows(spark: SparkSession, sf: str) -> DataFrame:
    clean, _ = cleaning.split_outputs(cleaning.sanitise(views.raw_history(spark, sf)))
    return clean


_COUNT = {
    "raw": "true", "empty": "is_empty", "non_empty": "not is_empty", "usable": "discard is null", "discarded": "discard is not null",
    "invalid_dates": "not is_empty and d is null", "observed_matches": "complete",
    "comparable_results": "not is_empty and hg is not null and ag is not null and res is not null",
    "result_mismatches": "not is_empty and case when hg > ag then '1' when hg < ag then '2' else 'X' end <> res and hg is not null and ag is not null",
    "administrative": "complete and no_stats and no_odds",
    "opening_available": "not is_empty and has_open", "effective_close_available": "not is_empty and ovr is not null",
    "real_close_available": "not is_empty and has_real", "without_real_close": "not is_empty and not has_real",
    "equal_open_close": "has_open and ovr is not null and o1 = e1 and ox = ex and o2 = e2",
    "equal_with_real_close": "has_open and has_real and o1 = e1 and ox = ex and o2 = e2",
    "overround_low": "ovr < 1.0", "overround_high": "ovr > 1.4", "shot_rows_without_schema": "not is_empty and old",
    "shot_rows_with_all_values": "not is_empty and shots_ok",
}
_COUNT_SQL = ", ".join(f"cast(sum(case when {v} then 1 else 0 end) as bigint) as {k}" for k, v in _COUNT.items())


@query("A12 A14 SRC3", FACTS + f"select _source_file as source_file, {_COUNT_SQL} from x group by _source_file")
def file_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.file_counters(facts(spark, sf)).select(F.col("_source_file").alias("source_file"), *_COUNT)


@query("A16", FACTS + f"select count(distinct _source_file) as files, {_COUNT_SQL} from x")
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return audit.totals(audit.file_counters(facts(spark, sf))).select("files", *_COUNT)


@query("A13", FACTS + """select discard as reason, count(*) as rows from x where discard is not null group by discard""")
def discard_primary_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return audit.reason_counts(facts(spark, sf))


@query("A13", FACTS + """
select reason, count(*) as rows from (select unnest([case when is_empty then 'EMPTY_ROW' end, case when not is_empty and d is null then 'INVALID_DATE' end,
  case when not is_empty and (ht = '' or at_ = '') then 'MISSING_MATCH_IDENTITY' end, case when not is_empty and (hg is null or ag is null) then 'MISSING_GOALS' end,
  case when not is_empty and res is null then 'MISSING_OR_INVALID_RESULT' end,
  case when not is_empty and (not has_open or ovr is null) then 'MISSING_REQUIRED_ODDS' end]) as reason from x) z where reason is not null group by reason""")
def discard_all_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return audit.reason_counts(facts(spark, sf), every=True)


@query("A15", FACTS + """, c as (select _source_file, _division, _season, sum(case when complete then 1 else 0 end) as obs, sum(case when discard is null then 1 else 0 end) as usable,
    sum(case when complete and no_stats and no_odds then 1 else 0 end) as adm, sum(case when not is_empty then 1 else 0 end) as ne,
    case _division when 'Primera' then 380 else 462 end as e from x group by 1, 2, 3)
select _source_file as source_file, _division as division, _season as season, cast(e as bigint) as expected_regular_matches, cast(obs as bigint) as observed_match_rows,
  cast(usable as bigint) as usable_rows, cast(adm as bigint) as administrative_candidates, cast(ne - usable - adm as bigint) as other_discarded_rows,
  cast(e - usable as bigint) as usable_gap, cast(e - obs as bigint) as observed_gap, cast(least(adm, greatest(e - usable, 0)) as bigint) as gap_explained_by_administrative
from c""")
def season_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.season_coverage(audit.file_counters(facts(spark, sf)))


@query("A11 A14", FACTS + """
select _division as division, round(min(ovr), 6) as minimum, round(quantile_cont(ovr, 0.5), 6) as median, round(max(ovr), 6) as maximum
from x where ovr is not null and not is_empty group by _division""")
def overround_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).select(F.col("_division").alias("division"), "_overround")
    return audit.observed_distribution(rows, "_overround", ["division"])


@query("A10 T7", FACTS + """, k as (select d, ht, at_, count(*) as n from x where not is_empty and d is not null and ht <> '' and at_ <> '' group by 1, 2, 3 having count(*) > 1)
select count(*) as groups, cast(coalesce(sum(n), 0) as bigint) as rows_involved, cast(coalesce(sum(n - 1), 0) as bigint) as excess_rows from k""")
def match_key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_metrics(audit.match_keys(facts(spark, sf)), ["date", "home", "away"])


@query("T7 A10", FACTS + """
select d as date, ht as home, at_ as away, count(*) as rows from x where not is_empty and d is not null and ht <> '' and at_ <> ''
group by 1, 2, 3 having count(*) > 1 order by 1, 2, 3 limit 20""")
def match_key_duplicate_examples(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_examples(audit.match_keys(facts(spark, sf)), ["date", "home", "away"], n=20)


@query("T7 A12", FACTS + """
select _source_file as source_file, _line as line, "Date" as value from (select *, row_number() over (partition by _source_file order by _line) as i
  from x where not is_empty and d is null) z where i <= 10""")
def invalid_date_examples(spark: SparkSession, sf: str) -> DataFrame:
    bad = facts(spark, sf).filter(~F.col("_empty") & F.col("_date").isNull())
    out = audit.first_examples(bad, ["_source_file"], ["_line"], 10)
    return out.select(F.col("_source_file").alias("source_file"), F.col("_line").alias("line"), F.col("Date").alias("value"))


_SOURCE = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HS", "AS", "HST", "AST", "HC", "B365H", "B365D", "B365A", "B365CH", "B365CD", "B365CA")
_CELLS = ", ".join(f"""coalesce(trim("{c}"), '')""" for c in _SOURCE)
_FILLED = " + ".join(f"""cast(trim("{c}") <> '' as int)""" for c in ("HS", "AS", "HST", "AST"))


def _findings_sql(facts_sql: str, rules: list[tuple[str, str, str, str, str]]) -> str:
    """Rows of the rules whose count is positive; every count and detail is an expression over the one-row table ``one``."""
    rows = " union all ".join(
        f"select '{code}' as code, '{severity}' as severity, '{findings.SEVERITIES[severity]}' as severity_rationale, '{message}' as message, "
        f"cast({count} as bigint) as count, {details} as details from one"
        for code, severity, message, count, details in rules
    )
    return f"{facts_sql} select * from ({rows}) z where count > 0"


_PAIR = "concat('{{\"groups\":', {p}_groups, ',\"excess_rows\":', {p}_excess, '}}')"
# Team names of the derived rows are three characters long, so no two are similar: ALIAS_CANDIDATE is never emitted here.
HISTORY_FINDINGS = _findings_sql(FACTS + f""",
fc as (
  select _source_file, _division, old, count(*) as raw, sum(case when discard is null then 1 else 0 end) as usable, {_COUNT_SQL.replace("as raw", "as raw_rows").replace("as usable", "as usable_rows")},
    sum(case when not is_empty and not old then 4 - ({_FILLED}) else 0 end) as cells
  from x group by _source_file, _division, old
),
tot as (
  select {", ".join(f"sum({k}) as {k}" for k in _COUNT if k not in ("raw", "usable"))}, sum(cells) as cells, count(*) filter (old) as old_files,
    sum(case when (case _division when 'Primera' then 380 else 462 end) <> usable then 1 else 0 end) as incomplete,
    string_agg('"' || _source_file || '"', ',' order by _source_file) filter (old) as old_names from fc
),
ex as (select count(*) as n from x group by _source_file, {_CELLS} having count(*) > 1),
ky as (select count(*) as n from x where not is_empty and d is not null and ht <> '' and at_ <> '' group by d, ht, at_ having count(*) > 1),
re as (select string_agg('"' || discard || '":' || n, ',' order by discard) as reasons from (select discard, count(*) as n from x where discard is not null group by discard) z),
one as (
  select *, equal_open_close - equal_with_real_close as equal_fallback from tot, re,
    (select count(*) as ex_groups, coalesce(sum(n), 0) as ex_rows, coalesce(sum(n - 1), 0) as ex_excess from ex),
    (select count(*) as ky_groups, coalesce(sum(n), 0) as ky_rows, coalesce(sum(n - 1), 0) as ky_excess from ky)
)""", [
    ("EMPTY_ROWS", "info", "Completely blank rows.", "empty", "null"),
    ("ROWS_DISCARDED", "warning", "Rows that miss a required field.", "discarded", "concat('{\"primary_reasons\":{', reasons, '}}')"),
    ("EXACT_DUPLICATE", "info", "Rows repeated within a file.", "ex_rows", _PAIR.format(p="ex")),
    ("MATCH_KEY_DUPLICATE", "warning", "Matches repeated by date and teams.", "ky_rows", _PAIR.format(p="ky")),
    ("RESULT_GOALS_MISMATCH", "warning", "Result contradicts the goals.", "result_mismatches", "null"),
    ("DATE_INVALID", "warning", "Dates that cannot be read.", "invalid_dates", "null"),
    ("SHOTS_COLUMNS_MISSING", "critical", "Files without shot columns.", "case when old_files > 0 then greatest(shot_rows_without_schema, 1) end",
     "concat('{\"affected_files\":[', old_names, '],\"file_count\":', old_files, '}')"),
    ("SHOTS_VALUES_MISSING", "warning", "Shot columns with missing values.", "non_empty - shot_rows_without_schema - shot_rows_with_all_values", "concat('{\"missing_cells\":', cells, '}')"),
    ("ODDS_OPEN_MISSING", "warning", "Rows without three opening odds.", "non_empty - opening_available", "null"),
    ("ODDS_NO_REAL_CLOSE", "critical", "Rows without three real closing odds.", "without_real_close", "concat('{\"equal_to_opening_via_fallback\":', equal_fallback, '}')"),
    ("ODDS_OPEN_EQUALS_CLOSE_NO_REAL_CLOSE", "info", "Opening equals close because there is no real close.", "equal_fallback", "'{\"parent_code\":\"ODDS_NO_REAL_CLOSE\"}'"),
    ("ODDS_OPEN_EQUALS_CLOSE_REAL", "info", "Opening equals a close that is really available.", "equal_with_real_close", "null"),
    ("ODDS_OVERROUND_OUT_OF_RANGE", "warning", "Overround outside the configured range.", "overround_low + overround_high",
     "concat('{\"below\":', overround_low, ',\"above\":', overround_high, ',\"range\":{\"minimum\":1.0,\"maximum\":1.4}}')"),
    ("SEASON_INCOMPLETE", "warning", "Seasons that miss usable matches.", "incomplete", "null"),
    ("ADMINISTRATIVE_MATCH_CANDIDATE", "warning", "Full results without statistics and odds.", "administrative", "null"),
])


@query("A12 A13 A14 A15 A16 A10 J16 findings", HISTORY_FINDINGS)
def history_findings(spark: SparkSession, sf: str) -> DataFrame:
    return audit.history_findings(facts(spark, sf))


@query("findings assembly", f"select severity, count(*) as findings from ({HISTORY_FINDINGS}) y group by severity")
def severity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return findings.severity_summary(audit.history_findings(facts(spark, sf)))


# ---------------------------------------------------------------------------
# Text and names
# ---------------------------------------------------------------------------

@query("F1 F2 F3", """
select doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(text)), '.', ''), '\\s+', ' ', 'g'))) as name_md5,
  md5(trim(regexp_replace(lower(strip_accents(replace(lower(text), 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))) as words_md5,
  md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) as key_md5
from documents""")
def folded_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    t = F.col("text")
    return docs.select(
        "doc_id", F.md5(text.fold_name(t)).alias("name_md5"), F.md5(text.fold_words(t)).alias("words_md5"),
        F.md5(text.fold_key(t)).alias("key_md5"),
    )


@query("F4", "select doc_id, md5(text) as text_md5 from documents")
def repaired_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts broken to Latin-1 mojibake and repaired again give the original texts."""
    docs = views.table(spark, sf, "documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    latin = F.when(F.col("text").rlike("[^\\x{0}-\\x{7F}]") & broken.rlike("[ÃÂ]"), broken).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(text.repair_mojibake(latin)).alias("text_md5"))


@query("F5", """
select p_partkey, regexp_matches(concat(p_name, ' ', case p_partkey % 4 when 0 then 'B' when 1 then 'II' when 2 then 'Fortuna CF' else 'Bilbao' end),
  '(?i)( (b|ii|u23|reserves?)$)|fortuna') as is_reserve from part""")
def reserve_names(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    suffix = F.when(k == 0, "B").when(k == 1, "II").when(k == 2, "Fortuna CF").otherwise("Bilbao")
    return part.select("p_partkey", text.is_reserve_name(F.concat_ws(" ", "p_name", suffix)).alias("is_reserve"))


@query("J4 J5 J6", """
select p_partkey, case p_partkey % 5 when 0 then 'Ath Bilbao' when 1 then 'Malaga' when 2 then 'Sociedad B' when 3 then trim(p_name) else 'La Coruna' end as resolved,
  case p_partkey % 5 when 0 then 'Athletic Club' when 1 then 'Malaga CF' when 2 then 'R. Sociedad B' when 3 then null else null end as prior_name
from part""")
def resolved_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = (
        F.when(k == 0, "  Athletic  CLUB").when(k == 1, "Málaga").when(k == 2, "Real Sociedad B.")
        .when(k == 3, F.concat(F.lit(" "), F.col("p_name"))).otherwise("Depor")
    )
    part = views.table(spark, sf, "part").select("p_partkey", name.alias("resolved"), name.alias("prior_name"))
    history = names.resolve_names(part, ["resolved"])
    return names.resolve_names(history, ["prior_name"], names.ROSTER_NAMES, keep_unknown=False)


@query("J5", "select p_type as key, count(distinct p_brand) as teams, min(p_brand) as first, max(p_brand) as last from part group by p_type having count(distinct p_brand) > 1")
def alias_collisions(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.table(spark, sf, "part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("canonical"))
    return names.alias_collisions(pairs)


@query("J16 F6 U4")
def alias_candidates(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    teams = part.select(
        F.concat_ws(" ", "p_name", "p_type").alias("team"), F.col("p_size").cast("string").alias("season")
    ).distinct()
    return names.alias_candidates(teams).select("left", "right", "similarity", "method", "overlaps")


_CLUB_NAME = """concat(case p_partkey % 5 when 0 then 'Real ' when 1 then 'CD ' else '' end, p_name, case p_partkey % 7 when 0 then ' F.C.' when 1 then ' Deportivo' else '' end)"""


@query("J16 F6 U4", f"""
with t as (select distinct {_CLUB_NAME} as team, cast(p_size as varchar(5)) as season from part),
n as (select team, list_sort(list(season)) as seasons, trim(regexp_replace(lower(team), '[^a-z0-9]+', ' ', 'g')) as folded from t group by team),
w as (
  select team, seasons, words, array_to_string(list_sort(list_filter(words, lambda x: not list_contains({list(names.CLUB_WORDS)}, x))), ' ') as core
  from (select team, seasons, list_distinct(string_split(folded, ' ')) as words from n)
)
select a.team as "left", b.team as "right", list_has_any(a.seasons, b.seasons) as overlaps
from w a join w b on a.core = b.core and a.team < b.team
where (list_has_all(b.words, a.words) and len(a.words) < len(b.words)) or (list_has_all(a.words, b.words) and len(b.words) < len(a.words))""")
def club_word_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that the alias search finds by words; the ratio of the others has no SQL."""
    teams = views.table(spark, sf, "part").select(F.expr(_CLUB_NAME).alias("team"), F.col("p_size").cast("string").alias("season")).distinct()
    return names.alias_candidates(teams).filter("method = 'tokens_with_club_qualifier'").select("left", "right", "overlaps")


@query("J16", """
select cast((n * (n - 1) - (n - r) * (n - r - 1)) / 2 as bigint) as reserve_pairs from (
  select count(*) as n, sum(case when regexp_matches(lower(team), '( |^)(b|ii|u23|reserves?)$') then 1 else 0 end) as r
  from (select distinct concat(p_name, case when p_size % 3 = 0 then ' b' else '' end) as team from part) t) z""")
def reserve_pair_count(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    team = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " b").otherwise(""))
    return names.reserve_pairs(part.select(team.alias("team"), F.lit("s").alias("season")))


# ---------------------------------------------------------------------------
# Results feed
# ---------------------------------------------------------------------------

FEED_SQL = """select concat('', cast(match_id - match_id % 50 % 2 as varchar(20))) as match_id, cast(match_date as varchar(10)) as date,
  case when division = 'Primera' then 'La Liga' else 'Segunda División' end as league_name, substr(season, 1, 4) as league_season,
  case when match_id % 19 = 0 then 'Promotion - Final' when match_id % 17 = 0 then 'Play-Off' else concat('Regular ', cast(match_id % 38 as varchar(5))) end as round,
  case when match_id % 13 = 0 then 'Cancelled' when match_id % 11 = 0 then '' when match_id % 7 = 0 then 'Finished after penalties' else 'Finished' end as status,
  home as home_name, away as away_name, case when match_id % 13 = 0 then '' else cast(fthg as varchar(5)) end as home_goals, cast(ftag as varchar(5)) as away_goals,
  case when match_id % 23 = 0 then '1' else result end as sign, match_id as row_id from ({matches}) m""".replace("{matches}", views.MATCHES_SQL)
FEED = f"""with fd as ({FEED_SQL}), ff as (select *, case when status = '' then '<empty>' else status end as st, status like 'Finished%' as fin,
  round like 'Promotion%' or round like 'Play-Off%' as po, home_goals = '' or away_goals = '' as nog,
  home_goals <> '' and case when home_goals > away_goals then '1' when home_goals < away_goals then '2' else 'X' end <> sign as wrong from fd)"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return views._spark_sql(spark, sf, FEED_SQL)


@query("A17 P34", FEED + """
select st as status, count(*) as rows, cast(sum(case when nog then 1 else 0 end) as bigint) as without_goals, bool_or(fin) as is_final from ff group by st""")
def feed_status(spark: SparkSession, sf: str) -> DataFrame:
    return feed_audit.status_counts(feed_audit.feed_facts(feed(spark, sf)))


@query("A17 P34", FEED + """
select league_name as league, league_season as season, count(*) as rows, cast(sum(case when fin then 1 else 0 end) as bigint) as finished,
  cast(sum(case when not fin then 1 else 0 end) as bigint) as non_finished, cast(sum(case when po then 1 else 0 end) as bigint) as playoffs,
  cast(sum(case when fin and not po then 1 else 0 end) as bigint) as regular_finished,
  cast(case league_name when 'La Liga' then 380 else 462 end as bigint) as expected_regular_matches,
  cast(case league_name when 'La Liga' then 380 else 462 end - sum(case when fin and not po then 1 else 0 end) as bigint) as regular_finished_gap
from ff group by 1, 2""")
def feed_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return feed_audit.league_coverage(feed_audit.feed_facts(feed(spark, sf)))


@query("A17", FEED + """select league_name as league, league_season as season, count(*) as rows from ff where po group by 1, 2""")
def feed_playoffs(spark: SparkSession, sf: str) -> DataFrame:
    return feed_audit.playoff_groups(feed_audit.feed_facts(feed(spark, sf)))


@query("A17", FEED + """
select count(*) as rows, cast(sum(case when not fin then 1 else 0 end) as bigint) as non_finished, cast(sum(case when nog then 1 else 0 end) as bigint) as without_goals,
  cast(sum(case when po then 1 else 0 end) as bigint) as playoffs, cast(sum(case when not nog then 1 else 0 end) as bigint) as comparable,
  cast(sum(case when wrong then 1 else 0 end) as bigint) as sign_mismatches, min(cast(date as date)) as first_date, max(cast(date as date)) as last_date,
  cast(0 as bigint) as invalid_dates from ff""")
def feed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return feed_audit.feed_summary(feed_audit.feed_facts(feed(spark, sf)))


@query("A10 A17", FEED + """, k as (select 'match_id' as kind, count(*) as n from fd group by match_id having count(*) > 1
  union all select 'logical', count(*) from fd group by date, home_name, away_name having count(*) > 1)
select 'exact' as kind, cast(0 as bigint) as groups, cast(0 as bigint) as rows_involved, cast(0 as bigint) as excess_rows
union all select kind, count(*), cast(sum(n) as bigint), cast(sum(n - 1) as bigint) from k group by kind""")
def feed_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return feed_audit.feed_duplicates(feed_audit.feed_facts(feed(spark, sf)))


_THREE = "concat('{{\"groups\":', {p}_groups, ',\"rows_involved\":', {p}_rows, ',\"excess_rows\":', {p}_excess, '}}')"


@query("A17 A10 findings", _findings_sql(FEED + """,
md as (select count(*) as n from fd group by match_id having count(*) > 1),
lg as (select count(*) as n from fd group by date, home_name, away_name having count(*) > 1),
cv as (select league_name, league_season, sum(case when fin and not po then 1 else 0 end) as done from ff group by 1, 2),
one as (
  select * from (select sum(case when not fin then 1 else 0 end) as open, sum(case when nog then 1 else 0 end) as nog, sum(case when po then 1 else 0 end) as po,
      sum(case when wrong then 1 else 0 end) as wrong from ff),
    (select count(*) filter (done <> case league_name when 'La Liga' then 380 else 462 end) as incomplete from cv),
    (select count(*) as md_groups, coalesce(sum(n), 0) as md_rows, coalesce(sum(n - 1), 0) as md_excess from md),
    (select count(*) as lg_groups, coalesce(sum(n), 0) as lg_rows, coalesce(sum(n - 1), 0) as lg_excess from lg),
    (select count(*) as ed_groups, coalesce(sum(n), 0) as ed_rows, coalesce(sum(n - 1), 0) as ed_excess from (select count(*) as n from fd
      group by match_id, date, league_name, league_season, round, status, home_name, away_name, home_goals, away_goals, sign having count(*) > 1))
)""", [
    ("HIGHLIGHTLY_NON_FINISHED", "info", "Matches that are not final.", "open", "null"),
    ("HIGHLIGHTLY_GOALS_MISSING", "info", "Rows without both goals.", "nog", "null"),
    ("HIGHLIGHTLY_PLAYOFF", "info", "Play-off rows kept apart from the league.", "po", "null"),
    ("HIGHLIGHTLY_EXACT_DUPLICATE", "warning", "Repeated rows.", "ed_rows", _THREE.format(p="ed")),
    ("HIGHLIGHTLY_MATCH_ID_DUPLICATE", "warning", "Repeated match ids.", "md_rows", _THREE.format(p="md")),
    ("HIGHLIGHTLY_LOGICAL_DUPLICATE", "warning", "Matches repeated by date and teams.", "lg_excess", _THREE.format(p="lg")),
    ("HIGHLIGHTLY_SEASON_INCOMPLETE", "warning", "League seasons that miss finished regular matches.", "incomplete", "null"),
    ("HIGHLIGHTLY_SIGN_MISMATCH", "warning", "Sign contradicts the goals.", "wrong", "null"),
]))
def feed_findings(spark: SparkSession, sf: str) -> DataFrame:
    return feed_audit.feed_findings(feed_audit.feed_facts(feed(spark, sf).drop("row_id")))


@query("SRC11", "select doc_id, true as valid_utf8, false as has_utf8_bom, cast(length(text) - length(replace(text, '�', '')) as bigint) as replacement_characters from documents")
def encoding_facts(spark: SparkSession, sf: str) -> DataFrame:
    files = views.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return feed_audit.encoding_facts(files).withColumnRenamed("path", "doc_id")


@query("SNK9", """
select doc_id as path, sha256(text) as sha256 from documents""")
def content_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    files = views.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return writers.fingerprints(files)


@query("SNK9", """
select count(*) as files, sha256(string_agg(sha256(html), '' order by page_id)) as combined from pages""")
def combined_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    files = views.table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return writers.combined_fingerprint(writers.fingerprints(files))


@query("J11 SRC12 SNK8 F7 F3", FACTS + ", " + FEED.removeprefix("with ") + """
select cast(match_id as bigint) as match_id, cast(date as date) as date, case when league_name = 'La Liga' then 'Primera' else 'Segunda' end as division,
  '1998-1999' as season, round, home_name as home, away_name as away, cast(home_goals as int) as home_goals, cast(away_goals as int) as away_goals,
  case when home_goals > away_goals then 'H' when home_goals < away_goals then 'A' else 'D' end as result, 'Highlightly' as source, true as missing_odds, true as missing_shots
from fd f where league_season = '1998' and status = 'Finished' and not exists (select 1 from x h where h.d = cast(f.date as date) and h.ht = f.home_name
  and h.at_ = f.away_name and h.hg is not null and h.ag is not null and h.res is not null and h.ovr is not null and h.has_open)""")
def missing_matches(spark: SparkSession, sf: str) -> DataFrame:
    season = feed_audit.season_feed(feed(spark, sf), "1998").drop("row_id")
    history = cleaning.typed_matches(views.raw_history(spark, sf))
    return missing.missing_matches(season, history, "1998-1999", check_unique=False)


# ---------------------------------------------------------------------------
# xG
# ---------------------------------------------------------------------------

XG_SQL = """select match_id, home, away, match_date, cast(match_date + cast(match_id % 5 as int) as date) as date, cast((fthg + match_id % 7) / 4.0 as double) as home_xg,
  cast((ftag + match_id % 6) / 4.0 as double) as away_xg, cast(case when match_id % 10 = 0 then null else match_id % 12 end as double) as home_xg_deep,
  cast(match_id % 9 as double) as away_xg_deep, cast(8 + match_id % 5 as double) as home_ppda, cast(9 + match_id % 4 as double) as away_ppda
  from ({matches}) m""".replace("{matches}", views.MATCHES_SQL)
# One xG row per key; days are shifted by 0 to 4 so that exact, near and far rows all occur.
XG = f"""with g as (select home, away, date, max(home_xg) as home_xg, max(away_xg) as away_xg, max(home_xg_deep) as home_xg_deep, max(away_xg_deep) as away_xg_deep,
  max(home_ppda) as home_ppda, max(away_ppda) as away_ppda from ({XG_SQL}) z group by home, away, date), m as ({views.MATCHES_SQL})"""


def xg_rows(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("home_xg", "away_xg", "home_xg_deep", "away_xg_deep", "home_ppda", "away_ppda")
    shifted = views._spark_sql(spark, sf, XG_SQL.replace(
        "cast(match_date + cast(match_id % 5 as int) as date)", "date_add(match_date, cast(match_id % 5 as int))"))
    return shifted.groupBy("home", "away", "date").agg(*[F.max(c).alias(c) for c in columns])


@query("J1 J2 J3 SRC10", XG + """, e as (select m.match_id, m.home, m.away, m.match_date, g.home_xg, g.away_xg, g.home_ppda,
    g.home_xg is not null and g.away_xg is not null and g.home_xg_deep is not null and g.away_xg_deep is not null and g.home_ppda is not null and g.away_ppda is not null as ok
  from m left join g on g.home = m.home and g.away = m.away and g.date = m.match_date),
n as (select e.match_id, count(*) as c, max(g.home_xg) as home_xg, max(g.away_xg) as away_xg, max(g.home_ppda) as home_ppda
  from e join g on g.home = e.home and g.away = e.away and abs(date_diff('day', g.date, e.match_date)) <= 3 where not e.ok group by e.match_id)
select e.match_id, round(case when n.c = 1 then n.home_xg else e.home_xg end, 6) as home_xg, round(case when n.c = 1 then n.away_xg else e.away_xg end, 6) as away_xg,
  round(case when n.c = 1 then n.home_ppda else e.home_ppda end, 6) as home_ppda, e.ok or coalesce(n.c = 1, false) as xg_matched
from e left join n on n.match_id = e.match_id""")
def xg_enriched(spark: SparkSession, sf: str) -> DataFrame:
    base = views.matches(spark, sf).drop("home_xg", "away_xg")
    out = xg.merge_xg(base, xg_rows(spark, sf))
    return out.select("match_id", r6("home_xg"), r6("away_xg"), r6("home_ppda"), "xg_matched")


@query("A26", XG + """
select count(*) > 0 as available, count(*) as matches, min(date) as date_from, max(date) as date_to,
  (select string_agg(y, '|' order by y) from (select distinct cast(year(date) as varchar) as y from g) q) as seasons from g""")
def xg_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return xg.xg_coverage(xg_rows(spark, sf))


# ---------------------------------------------------------------------------
# Season priors
# ---------------------------------------------------------------------------

PRIOR_SQL = f"""with m as ({views.MATCHES_SQL}), t as (
  select case when division = 'Primera' then 'La Liga' else 'Segunda Division' end as league, 'home' as side, home as team, fthg as gf, ftag as gc, match_id from m
  union all select case when division = 'Primera' then 'La Liga' else 'Segunda Division' end, 'away', away, ftag, fthg, match_id from m),
s as (select team, count(*) as pj, sum(case when gf > gc then 1 else 0 end) as g, sum(case when gf = gc then 1 else 0 end) as e, sum(case when gf < gc then 1 else 0 end) as p,
    sum(gf) as gf, sum(gc) as gc, sum(case when gf > gc then 3 when gf = gc then 1 else 0 end) as pts, sum(case when side = 'home' then 1 else 0 end) as home_pj,
    sum(case when side = 'home' then case when gf > gc then 3 when gf = gc then 1 else 0 end else 0 end) as home_pts, max(league) as source_main_league from t group by team)
"""


@query("A6 A7", PRIOR_SQL + """
select team, pj, cast(g as bigint) as g, cast(e as bigint) as e, cast(p as bigint) as p, cast(gf as bigint) as gf, cast(gc as bigint) as gc, cast(pts as bigint) as pts,
  cast(gf - gc as bigint) as dg, round(pts / cast(pj as double), 3) as ppg, round(gf / cast(pj as double), 3) as gf_per_match, cast(home_pj as bigint) as home_pj,
  round(home_pts / cast(home_pj as double), 3) as home_ppg, source_main_league from s""")
def season_team_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = priors.season_stats(_results(spark, sf))
    return stats.select(
        "team", "pj", "g", "e", "p", "gf", "gc", "pts", "dg", "ppg", "gf_per_match", "home_pj", "home_ppg", "source_main_league"
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    league = F.when(F.col("division") == "Primera", "La Liga").otherwise("Segunda División")
    return views.matches(spark, sf).select(
        league.alias("league"), "home", "away", F.col("FTHG").alias("home_goals"), F.col("FTAG").alias("away_goals")
    )


def _roster(spark: SparkSession, sf: str) -> DataFrame:
    """A roster in which some teams change category and some have no matches."""
    seen = views.matches(spark, sf).select(F.explode(F.array("home", "away")).alias("team")).distinct()
    number = F.substring("team", 2, 2).cast("int")
    target = F.when(number % 3 == 0, F.when(F.col("team").startswith("P"), "Segunda Division").otherwise("La Liga")).otherwise(
        F.when(F.col("team").startswith("P"), "La Liga").otherwise("Segunda Division")
    )
    known = seen.select("team", target.alias("target_competition"), F.lit("permanece").alias("status"))
    nations = views.table(spark, sf, "nation")
    k = F.col("n_nationkey") % 3
    status = F.when(k == 0, "ascendido_primera_rfef").when(k == 1, "ascendido_primera_rfef_filial").otherwise("permanece")
    return known.unionByName(
        nations.select(F.col("n_name").alias("team"), F.lit("Segunda Division").alias("target_competition"), status.alias("status"))
    )


_CONTEXT = PRIOR_SQL + """, ro as (select team, case when cast(substr(team, 2, 2) as int) % 3 = 0 then case when team like 'P%' then 'Segunda Division' else 'La Liga' end
      else case when team like 'P%' then 'La Liga' else 'Segunda Division' end end as target, 'permanece' as status from s
  union all select n_name, 'Segunda Division', case n_nationkey % 3 when 0 then 'ascendido_primera_rfef' when 1 then 'ascendido_primera_rfef_filial' else 'permanece' end from nation),
c as (select ro.team, ro.target, coalesce(s.pj, 0) as pj, s.pts, case when s.pj is null then case status when 'ascendido_primera_rfef_filial' then 'filial_primera_rfef_a_segunda'
      when 'ascendido_primera_rfef' then 'primera_rfef_a_segunda' else 'sin_muestra' end
    when target = 'La Liga' and source_main_league = 'Segunda Division' then 'segunda_a_primera'
    when target = 'Segunda Division' and source_main_league = 'La Liga' then 'primera_a_segunda' else 'misma_categoria' end as transition
  from ro left join s on s.team = ro.team),
q as (select *, case transition when 'misma_categoria' then 1.0 when 'segunda_a_primera' then 0.78 when 'primera_a_segunda' then 1.12
    when 'primera_rfef_a_segunda' then 0.7 when 'filial_primera_rfef_a_segunda' then 0.66 end as factor, case when pj > 0 then round(pts / cast(pj as double), 3) end as raw_ppg from c)
"""


@query("A8 SRC8 SRC9 M22", _CONTEXT + """
select team, target as target_competition, transition, cast(round(factor, 3) as double) as transition_factor, raw_ppg, cast(round(raw_ppg * factor, 3) as double) as adjusted_ppg,
  case when transition = 'sin_muestra' then 'muy_baja' when transition in ('primera_rfef_a_segunda', 'filial_primera_rfef_a_segunda') then 'baja' when pj < 30 then 'media'
    when transition = 'misma_categoria' then 'alta' else 'media' end as confidence from q""")
def season_priors(spark: SparkSession, sf: str) -> DataFrame:
    return _priors(spark, sf).select(
        "team", "target_competition", "transition", "transition_factor", "raw_ppg", "adjusted_ppg", "confidence"
    )


def _priors(spark: SparkSession, sf: str) -> DataFrame:
    stats = priors.season_stats(_results(spark, sf))
    joined_rows = _roster(spark, sf).join(stats, "team", "left").fillna(0, ["pj", "pts"])
    return priors.with_context(joined_rows)


@query("A9", _CONTEXT + "select team, cast(pj as bigint) as pj from q where pj < 20")
def low_sample_teams(spark: SparkSession, sf: str) -> DataFrame:
    return priors.low_sample_teams(_priors(spark, sf))


@query("J7 J8", _CONTEXT + """, w as (select m.match_id, m.match_id % 5 as hpj, (m.match_id % 7) / 3.0 as hppg, round(q.raw_ppg * q.factor, 3) as prior from m left join q on q.team = m.home)
select match_id, round(case when hpj < 3 and prior is not null then (hpj / 3.0) * hppg + (1 - hpj / 3.0) * prior else hppg end, 6) as home_ppg from w""")
def prior_mixed_ppg(spark: SparkSession, sf: str) -> DataFrame:
    m = views.matches(spark, sf).select(
        "match_id", "home", "away", (F.col("match_id") % 5).cast("double").alias("home_table_pj"),
        ((F.col("match_id") % 7) / 3.0).alias("home_table_ppg"), F.lit(9.0).alias("away_table_pj"), F.lit(1.0).alias("away_table_ppg"),
        F.lit(0.0).alias("table_ppg_diff"),
    )
    keys = priors.prior_keys(_priors(spark, sf).select("team", "adjusted_ppg"))
    return priors.apply_transition_priors(m, keys).select("match_id", r6("home_table_ppg", "home_ppg"))


@query("J17 A19 U3", _CONTEXT + """
select 'only_roster' as kind, count(*) as teams from ro where team not in (select team from s) union all
select 'both', count(*) from ro where team in (select team from s)""")
def roster_against_priors(spark: SparkSession, sf: str) -> DataFrame:
    stats = priors.season_stats(_results(spark, sf))
    have = stats.select("team", F.lit(True).alias("in_priors"))
    both = _roster(spark, sf).select("team", F.lit(True).alias("in_roster")).join(have, "team", "full_outer")
    kind = F.when(F.col("in_priors").isNull(), "only_roster").when(F.col("in_roster").isNull(), "only_priors").otherwise("both")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("teams"))


@query("P1 P5 P6", """
select match_id, case upper(trim(code)) when 'H' then '1' when '1' then '1' when '0' then '1' when '0.0' then '1' when 'D' then 'X' when 'X' then 'X' when '1.0' then 'X'
  when 'A' then '2' when '2' then '2' when '2.0' then '2' end as result
from (select o_orderkey as match_id, case o_orderkey % 13 when 0 then ' h' when 1 then '1' when 2 then '0' when 3 then '0.0' when 4 then 'd' when 5 then 'x ' when 6 then '1.0'
  when 7 then 'A' when 8 then '2' when 9 then '2.0' when 10 then '' when 11 then '3' end as code from orders) z""")
def result_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in (" h", "1", "0", "0.0", "d", "x ", "1.0", "A", "2", "2.0", "", "3", None)])
    orders = views.table(spark, sf, "orders")
    code = F.get(codes, (F.col("o_orderkey") % 13).cast("int"))
    return orders.select(F.col("o_orderkey").alias("match_id"), odds.normalise_result(code).alias("result"))
