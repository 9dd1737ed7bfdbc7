"""The queries by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers, times
from ..functions.predicates import state_unavailable, statistics_available
from ..functions.text import gap_text, reset_text, span_text
from ..operators import attributes, diff, profile, quality
from ..operators.generate import copied_rows, ends_of_predecessors, generate, generate_runs, generated_counts, preview
from ..operators.splice import applied_changes, eligibility, quality_checks, splice
from ..schema import INTERVALS
from ..sources.registry import document_errors, entities_of, entity
from ..sources.sinks import as_target_rows, replace_series, without_target_id
from ..sources.tables import canonical_states, canonical_statistics, only_series
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
HOURLY = {"statistics": INTERVALS["statistics"]}
SHORT = {"statistics_short_term": INTERVALS["statistics_short_term"]}


def _flat(df: DataFrame, parts: tuple[str, ...], fields: tuple[str, ...], *first: str) -> DataFrame:
    return df.select(*first, *(F.col(f"{p}.{f}").alias(f"{p}_{f}") for p in parts for f in fields))


def _of(tables: dict, df: DataFrame) -> DataFrame:
    return df.where(F.col("table").isin(*tables))


# --- gaps -------------------------------------------------------------------


def missing_rows_hourly(spark, sf_dir):
    return quality.missing_rows(_of(HOURLY, fx.statistics(spark, sf_dir)))


def missing_rows_short(spark, sf_dir):
    return quality.missing_rows(_of(SHORT, fx.statistics(spark, sf_dir)))


def missing_rows_dense(spark, sf_dir):
    return quality.missing_rows(fx.statistics(spark, sf_dir, "type"))


def missing_rows_text(spark, sf_dir):
    gaps = quality.missing_rows(_of(HOURLY, fx.statistics(spark, sf_dir)))
    return gaps.select("series_id", "before_ts", gap_text().alias("gap"))


# --- profiles ---------------------------------------------------------------


def state_summary(spark, sf_dir):
    summary = profile.summarize_states(fx.states(spark, sf_dir))
    return _flat(summary, profile.ENDS, ("ts", "value"), "series_id", "row_count", "unavailable_count")


def statistics_summary(spark, sf_dir):
    summary = profile.summarize_statistics(fx.statistics(spark, sf_dir))
    return _flat(summary, profile.ENDS, ("ts", "value", "sum"), "series_id", "table", "row_count", "unavailable_count")


def _all_summary(spark, sf_dir) -> DataFrame:
    return profile.summarize_all(fx.states(spark, sf_dir), fx.statistics(spark, sf_dir), F.lit(True))


def summary_all(spark, sf_dir):
    return _flat(
        _all_summary(spark, sf_dir),
        profile.ENDS,
        ("ts", "value", "sum"),
        "series_id",
        "table",
        "row_count",
        "unavailable_count",
    )


def summary_diff(spark, sf_dir):
    pairs = fx.replacements(spark, sf_dir)
    return attributes.compare_summaries(_all_summary(spark, sf_dir), pairs, ("states", *INTERVALS)).drop("rank")


def state_outage_runs(spark, sf_dir):
    return profile.state_outages(fx.states(spark, sf_dir))


def state_outage_runs_dense(spark, sf_dir):
    return profile.state_outages(fx.states(spark, sf_dir, "type"))


def statistics_outage_runs(spark, sf_dir):
    return profile.statistics_outages(fx.statistics(spark, sf_dir))


def outage_report(spark, sf_dir):
    runs = profile.outages(fx.states(spark, sf_dir), fx.statistics(spark, sf_dir))
    when = span_text(F.col("start_ts"), F.col("end_ts"), F.col("row_count"))
    return runs.select("series_id", "table", "start_ts", when.alias("when"), "value", "row_count")


def earliest_state(spark, sf_dir):
    return profile.earliest_state(fx.states(spark, sf_dir))


def latest_statistics(spark, sf_dir):
    return profile.latest_statistics(fx.statistics(spark, sf_dir))


def last_reset_rows(spark, sf_dir):
    return profile.last_reset_rows(fx.statistics(spark, sf_dir))


def last_reset_rows_text(spark, sf_dir):
    """Of a table that keeps reset marks only as text."""
    stored = fx.recorder_statistics(spark, sf_dir)
    return profile.last_reset_rows(canonical_statistics(stored["statistics"], stored["statistics_meta"]), "text")


def last_reset_rows_text_both(spark, sf_dir):
    return profile.last_reset_rows(_stored(spark, sf_dir), "text")


def _of_two_ages(spark, sf_dir) -> DataFrame:
    """Statistics of two sites: tables of the one keep reset marks as epochs, those of the other as text."""
    newer = fx.statistics(spark, sf_dir).where(fx.at_newer_site())
    older = fx.recorder_statistics(spark, sf_dir)
    tables = [
        canonical_statistics(newer.where(F.col("table") == t).withColumnRenamed("series_id", "statistic_id"), table=t, layout=True)
        for t in INTERVALS
    ]
    tables += [
        canonical_statistics(older[t], older["statistics_meta"], table=t, layout=True).where(~fx.at_newer_site()) for t in INTERVALS
    ]
    return reduce(DataFrame.unionByName, tables)


def last_reset_rows_two_ages(spark, sf_dir):
    return profile.last_reset_rows(_of_two_ages(spark, sf_dir))


def statistics_resets_two_ages(spark, sf_dir):
    return quality.statistics_resets(_of_two_ages(spark, sf_dir), "total")


# --- resets -----------------------------------------------------------------


def state_resets_increasing(spark, sf_dir):
    return quality.state_resets(fx.states(spark, sf_dir)).drop("last_reset_ts")


def state_resets_dense(spark, sf_dir):
    return quality.state_resets(fx.states(spark, sf_dir, "type")).drop("last_reset_ts")


def state_resets_total(spark, sf_dir):
    return quality.state_resets(fx.states(spark, sf_dir), "total")


def statistics_resets_increasing(spark, sf_dir):
    return quality.statistics_resets(fx.statistics(spark, sf_dir), "total_increasing")


def statistics_resets_total(spark, sf_dir):
    return quality.statistics_resets(fx.statistics(spark, sf_dir), "total")


def statistics_resets_text(spark, sf_dir):
    return quality.statistics_resets(_stored(spark, sf_dir), "total", "text")


def statistics_resets_any_fall(spark, sf_dir):
    return quality.statistics_resets(fx.statistics(spark, sf_dir), None)


def reset_report(spark, sf_dir):
    report = quality.reset_report(fx.states(spark, sf_dir), fx.statistics(spark, sf_dir), fx.classes(spark, sf_dir))
    return report.select("report", "series_id", "table", "event_ts", "last_reset_ts", reset_text().alias("range"))


# --- generation -------------------------------------------------------------


def _generated(spark, sf_dir, kind, tables, from_zero=False, by="user", build=generate, **options) -> DataFrame:
    return build(
        fx.states(spark, sf_dir, by),
        fx.statistics(spark, sf_dir, by),
        fx.replacements(spark, sf_dir, kind, from_zero, by),
        tables,
        run_ts=fx.RUN_TS,
        **options,
    )


def _runs(spark, sf_dir) -> DataFrame:
    """All kinds and both tables, as runs."""
    return _generated(spark, sf_dir, None, INTERVALS, True, build=generate_runs)


def generate_increasing_hourly(spark, sf_dir):
    return _generated(spark, sf_dir, "total_increasing", HOURLY)


def generate_increasing_short(spark, sf_dir):
    return _generated(spark, sf_dir, "total_increasing", SHORT)


def generate_increasing_from_zero(spark, sf_dir):
    return _generated(spark, sf_dir, "total_increasing", HOURLY, True)


def generate_increasing_dense(spark, sf_dir):
    return _generated(spark, sf_dir, "total_increasing", INTERVALS, by="type")


def generate_total_hourly(spark, sf_dir):
    return _generated(spark, sf_dir, "total", HOURLY, True)


def generate_total_text_marks(spark, sf_dir):
    return _generated(spark, sf_dir, "total", HOURLY, True, last_reset_as="text")


def generate_measurement_hourly(spark, sf_dir):
    return _generated(spark, sf_dir, "measurement", HOURLY)


def generate_all_kinds(spark, sf_dir):
    return _generated(spark, sf_dir, None, INTERVALS, True)


def copied_statistics(spark, sf_dir):
    return copied_rows(fx.statistics(spark, sf_dir), fx.replacements(spark, sf_dir))


def generated_gaps(spark, sf_dir):
    pairs = fx.replacements(spark, sf_dir, None, True)
    return quality_checks(_runs(spark, sf_dir), pairs)["gaps"]


def generated_resets(spark, sf_dir):
    pairs = fx.replacements(spark, sf_dir, None, True)
    return quality_checks(_runs(spark, sf_dir), pairs)["resets"]


def generated_counts_by_table(spark, sf_dir):
    return generated_counts(_runs(spark, sf_dir))


def generated_preview(spark, sf_dir):
    return preview(
        _runs(spark, sf_dir),
        fx.statistics(spark, sf_dir),
        fx.replacements(spark, sf_dir, None, True),
    )


# --- differences ------------------------------------------------------------


def _edited(statistics: DataFrame) -> DataFrame:
    """A later version of the statistics: empty rows removed, others moved or changed."""
    state, mark = F.col("state"), F.col("last_reset_ts")
    moved = F.when(mark.isNull(), F.col("start_ts") + F.col("interval_s") * 1000).otherwise(F.col("start_ts"))
    return statistics.where(statistics_available()).withColumns(
        {
            "start_ts": moved,
            "state": F.when(state < 200_000, state + 1.5).otherwise(state),
            "sum": F.col("sum") + 10,
            "last_reset_ts": F.when(state > 600_000, mark + 0.25).otherwise(mark),
            "created_ts": F.lit(fx.RUN_TS),
        }
    )


def _changes(spark, sf_dir) -> DataFrame:
    before = fx.statistics(spark, sf_dir)
    return diff.change_report(before, _edited(before))


def _flat_changes(report: DataFrame, *more: str) -> DataFrame:
    return report.select(
        "series_id",
        "table",
        "start_ts",
        *(F.col(f"{c}.{s}").alias(f"{c}_{s}") for c in ("state", "sum", "mean", "min", "max") for s in ("old", "new", "delta")),
        *(F.col(f"{c}.{s}").alias(f"{c}_{s}") for c in ("last_reset_ts", "created_ts") for s in ("old", "new")),
        *more,
    )


def change_report(spark, sf_dir):
    return _flat_changes(_changes(spark, sf_dir))


def change_report_by_cells(spark, sf_dir):
    """Of two versions that differ in some series only."""
    before = fx.statistics(spark, sf_dir)
    touched = F.col("series_id").contains("1_")
    after = _edited(before.where(touched)).unionByName(before.where(~touched))
    return _flat_changes(diff.change_report_by_cells(before, after))


def change_report_text(spark, sf_dir):
    return diff.change_cells(_changes(spark, sf_dir)).select(
        "series_id", "table", "start_ts", "start", "state", "sum", "created_ts"
    )


def changed_columns(spark, sf_dir):
    found = diff.changed_columns(_changes(spark, sf_dir))
    return found.select("series_id", "table", F.array_join("columns", ",").alias("columns"))


def change_report_condensed(spark, sf_dir):
    before = fx.statistics(spark, sf_dir)
    return _flat_changes(diff.condensed_report(before, _edited(before)), "omitted_before")


def _planned(spark, sf_dir, report=diff.planned_changes) -> DataFrame:
    return report(fx.statistics(spark, sf_dir), _runs(spark, sf_dir), fx.replacements(spark, sf_dir, None, True))


def snapshot_after_predecessors(spark, sf_dir):
    statistics, pairs = fx.statistics(spark, sf_dir), fx.replacements(spark, sf_dir)
    cut = ends_of_predecessors(statistics, pairs).withColumnRenamed("end_ts", "cut_ts")
    return diff.snapshot(only_series(statistics, pairs, "new_id"), cut)


def planned_changes(spark, sf_dir):
    return _flat_changes(_planned(spark, sf_dir))


def planned_changes_condensed(spark, sf_dir):
    return _flat_changes(_planned(spark, sf_dir, diff.planned_changes_condensed), "omitted_before")


def applied_changes_after_swap(spark, sf_dir):
    before = fx.statistics(spark, sf_dir)
    pairs = fx.replacements(spark, sf_dir, None, True)
    after = replace_series(before, _runs(spark, sf_dir), pairs)
    return _flat_changes(applied_changes(before, after, before, pairs))


# --- splice and sinks -------------------------------------------------------


def replacement_eligibility(spark, sf_dir):
    pairs = fx.replacements(spark, sf_dir).select("old_id", "new_id")
    return eligibility(pairs, fx.classes(spark, sf_dir), fx.states(spark, sf_dir), fx.statistics(spark, sf_dir))


def eligibility_without_target(spark, sf_dir):
    """A dictionary that lacks the successors that only measure."""
    classes = fx.classes(spark, sf_dir)
    meta = classes.where("state_class <> 'measurement'").select(F.col("series_id").alias("statistic_id"))
    pairs = fx.replacements(spark, sf_dir).select("old_id", "new_id")
    found = eligibility(pairs, classes, fx.states(spark, sf_dir), fx.statistics(spark, sf_dir), meta)
    return found.select("old_id", "new_id", "eligible", "reason")


def _spliced(spark, sf_dir):
    pairs = fx.replacements(spark, sf_dir).select("old_id", "new_id")
    return splice(
        pairs, fx.classes(spark, sf_dir), fx.states(spark, sf_dir), fx.statistics(spark, sf_dir), run_ts=fx.RUN_TS
    )


def splice_counts(spark, sf_dir):
    return _spliced(spark, sf_dir)["counts"]


def splice_result(spark, sf_dir):
    return _spliced(spark, sf_dir)["result"]


def replace_series_result(spark, sf_dir):
    pairs = fx.replacements(spark, sf_dir, None, True)
    return replace_series(
        fx.statistics(spark, sf_dir), _generated(spark, sf_dir, None, INTERVALS, True), pairs
    )


def replace_series_target_rows(spark, sf_dir):
    stored = fx.recorder_statistics(spark, sf_dir)
    generated = _generated(spark, sf_dir, "total", HOURLY, True, last_reset_as="text")
    return as_target_rows(generated, stored["statistics"].drop("id"), stored["statistics_meta"], fx.RUN_TS)


def _generated_from_stored(spark, sf_dir, kind):
    pairs = fx.replacements(spark, sf_dir, kind, True)
    return generate(fx.states(spark, sf_dir), _stored(spark, sf_dir), pairs, INTERVALS, run_ts=fx.RUN_TS, last_reset_as="text")


def replace_series_target_rows_both(spark, sf_dir):
    stored = fx.recorder_statistics(spark, sf_dir)
    generated = _generated_from_stored(spark, sf_dir, "total")
    hourly, short = (
        as_target_rows(generated.where(F.col("table") == t), stored[t].drop("id"), stored["statistics_meta"], fx.RUN_TS).withColumn("table", F.lit(t))
        for t in INTERVALS
    )
    return hourly.unionByName(short)


def replace_series_both_tables(spark, sf_dir):
    """Both tables as stored, with reset marks only as text."""
    pairs = fx.replacements(spark, sf_dir, None, True)
    return replace_series(_stored(spark, sf_dir), _generated_from_stored(spark, sf_dir, None), pairs)


def splice_text_marks(spark, sf_dir):
    pairs = fx.replacements(spark, sf_dir).select("old_id", "new_id")
    parts = splice(
        pairs, fx.classes(spark, sf_dir), fx.states(spark, sf_dir), _stored(spark, sf_dir), run_ts=fx.RUN_TS, last_reset_as="text"
    )
    return parts["result"]


def pairs_without_target_id(spark, sf_dir):
    # A dictionary that knows only the sensors that count something.
    counting = fx.classes(spark, sf_dir).where("state_class <> 'measurement'")
    meta = counting.select(F.col("series_id").alias("statistic_id"))
    return without_target_id(fx.replacements(spark, sf_dir), meta)


# --- registry and attributes ------------------------------------------------


def _entities(spark, sf_dir) -> DataFrame:
    return entities_of(fx.registry_documents(spark, sf_dir))


def registry_entities(spark, sf_dir):
    return _entities(spark, sf_dir).select(
        "site",
        "entity_id",
        F.try_variant_get("attrs", "$.unique_id", "string").alias("unique_id"),
        F.try_variant_get("attrs", "$.options.b", "bigint").alias("option_b"),
    )


def registry_errors(spark, sf_dir):
    return document_errors(fx.registry_documents(spark, sf_dir))


def registry_lookup(spark, sf_dir):
    found = entity(_entities(spark, sf_dir), "sensor.c7_new")
    return found.select("site", "entity_id", F.try_variant_get("attrs", "$.name", "string").alias("name"))


def entity_state_classes(spark, sf_dir):
    return attributes.state_classes(_entities(spark, sf_dir))


def entity_attribute_diff(spark, sf_dir):
    return attributes.compare_attributes(_entities(spark, sf_dir), fx.customer_pairs(spark, sf_dir))


def entity_attribute_diff_sites(spark, sf_dir):
    """Every site has entities of the same two ids."""
    entities = _entities(spark, sf_dir)
    entities = entities.withColumn("entity_id", F.regexp_replace("entity_id", "c[0-9]+_", "c_"))
    pairs = spark.range(1).select(F.lit("sensor.c_old").alias("old_id"), F.lit("sensor.c_new").alias("new_id"))
    return attributes.compare_attributes(entities, pairs)


def attribute_probe(spark, sf_dir):
    stored = fx.recorder_states(spark, sf_dir)
    states = canonical_states(
        stored["states"], stored["states_meta"], stored["state_attributes"], attributes="probe"
    )
    return attributes.attribute_probe(states, per_series=5)


# --- scans and scalar functions ---------------------------------------------


def states_from_dictionary(spark, sf_dir):
    stored = fx.recorder_states(spark, sf_dir)
    return canonical_states(stored["states"], stored["states_meta"], stored["state_attributes"])


def states_for_detection(spark, sf_dir):
    stored = fx.recorder_states(spark, sf_dir)
    states = canonical_states(
        stored["states"], stored["states_meta"], stored["state_attributes"], attributes="detect"
    )
    return states.drop("attrs_fallback")


def states_from_legacy(spark, sf_dir):
    return canonical_states(fx.legacy_states(spark, sf_dir), text_zone="utc").drop("attrs_fallback")


def states_from_legacy_zones(spark, sf_dir):
    """Three sites that wrote local times, each in its own zone."""
    rows = fx.legacy_states(spark, sf_dir)
    sites = [
        canonical_states(rows.where(F.col("state_id") % len(fx.ZONES) == n), text_zone=zone) for n, zone in enumerate(fx.ZONES)
    ]
    return reduce(DataFrame.unionByName, sites).select("series_id", "ts", "row_id", "state")


def statistics_from_dictionary(spark, sf_dir):
    stored = fx.recorder_statistics(spark, sf_dir)
    return canonical_statistics(stored["statistics"], stored["statistics_meta"])


def _stored(spark, sf_dir):
    """Both stored tables, canonical."""
    stored = fx.recorder_statistics(spark, sf_dir)
    hourly, short = (canonical_statistics(stored[t], stored["statistics_meta"], table=t) for t in INTERVALS)
    return hourly.unionByName(short)


def statistics_from_dictionaries(spark, sf_dir):
    return _stored(spark, sf_dir)


def statistics_of_successors(spark, sf_dir):
    wanted = fx.replacements(spark, sf_dir, None).where("kind = 'total'")
    return only_series(fx.statistics(spark, sf_dir), wanted, "new_id")


def state_numbers(spark, sf_dir):
    return fx.states(spark, sf_dir).select(
        "row_id",
        numbers.leading_number("state").alias("leading"),
        numbers.whole_number("state").alias("whole"),
        state_unavailable().alias("unavailable"),
        numbers.bucket("ts", 3600).alias("hour"),
    )


def reset_mark_times(spark, sf_dir):
    text = F.get_json_object("attrs", "$.last_reset")
    return fx.states(spark, sf_dir).select(
        "row_id",
        times.reset_epoch(text).alias("mark"),
        times.reset_instant(text).alias("instant"),
        times.reset_instant(F.substring(text, 1, 19)).alias("naive_instant"),
        times.text_epoch_utc(text).alias("utc"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        missing_rows_hourly,
        missing_rows_short,
        missing_rows_dense,
        missing_rows_text,
        state_summary,
        statistics_summary,
        summary_all,
        summary_diff,
        state_outage_runs,
        state_outage_runs_dense,
        statistics_outage_runs,
        outage_report,
        earliest_state,
        latest_statistics,
        last_reset_rows,
        last_reset_rows_text,
        last_reset_rows_text_both,
        last_reset_rows_two_ages,
        statistics_resets_two_ages,
        state_resets_increasing,
        state_resets_dense,
        state_resets_total,
        statistics_resets_increasing,
        statistics_resets_total,
        statistics_resets_text,
        statistics_resets_any_fall,
        reset_report,
        generate_increasing_hourly,
        generate_increasing_short,
        generate_increasing_from_zero,
        generate_increasing_dense,
        generate_total_hourly,
        generate_total_text_marks,
        generate_measurement_hourly,
        generate_all_kinds,
        copied_statistics,
        generated_gaps,
        generated_resets,
        generated_counts_by_table,
        generated_preview,
        change_report,
        change_report_by_cells,
        change_report_text,
        changed_columns,
        change_report_condensed,
        snapshot_after_predecessors,
        planned_changes,
        planned_changes_condensed,
        applied_changes_after_swap,
        replacement_eligibility,
        eligibility_without_target,
        splice_counts,
        splice_result,
        replace_series_result,
        replace_series_target_rows,
        replace_series_target_rows_both,
        replace_series_both_tables,
        splice_text_marks,
        pairs_without_target_id,
        registry_entities,
        registry_errors,
        registry_lookup,
        entity_state_classes,
        entity_attribute_diff,
        entity_attribute_diff_sites,
        attribute_probe,
        states_from_dictionary,
        states_for_detection,
        states_from_legacy,
        states_from_legacy_zones,
        statistics_from_dictionary,
        statistics_from_dictionaries,
        statistics_of_successors,
        state_numbers,
        reset_mark_times,
    )
}
