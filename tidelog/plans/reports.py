"""Reports: named sections of queries as Markdown tables of bounded length."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidelog.plans import all_registries

#: The sections of each report, as names of queries.
REPORTS = {
    "duplicates": ["delivery_totals", "loader_list_by_entity", "loader_list_busiest_days", "conflicts_by_entity", "conflicts_by_source_pair", "conflicts_by_message_pair"],
    "behaviour": ["behavioral_metrics", "change_point_counts", "change_points", "silent_weeks", "rotation_shifts"],
    "advisories": ["advisories_once", "effect_sizes", "largest_effects", "change_point_advisories", "advisory_type_matches", "changes_near_advisories", "nearest_advisory"],
    "fillers": ["sentinel_windows", "sentinel_events", "fleet_flashes", "sentinel_episodes", "sentinel_advisories", "lifecycle_match_rate", "unmatched_events", "advisory_permutations"],
    "regimes": ["groups_per_day", "diversity_by_month", "lifetimes_by_month", "yearly_summary", "calendar_months", "first_days"],
    "significance": ["shared_substrings", "message_concentration", "concentration_p_values", "entropy_rank_sum", "entropy_ks", "alphabet_uniformity", "entropy_zscores", "alphabet_capacity"],
    "entropy": ["leave_one_out_summary", "leave_one_out_bits", "random_baseline", "entropy_peak", "byte_histogram"],
    "corpus": ["corpus_totals", "text_totals", "text_by_entity", "payload_rarity", "exclusive_payloads", "entity_overlap"],
}


def markdown_report(spark: SparkSession, sf_dir: str, name: str, rows: int = 20) -> str:
    """One report; a section shows at most ``rows`` rows and says if there are more."""
    queries = {n: f for r in all_registries() for n, f in r.queries.items()}
    out = [f"# {name.capitalize()}"]
    for section in REPORTS[name]:
        df = queries[section](spark, sf_dir)
        got = df.limit(rows + 1).collect()
        cell = lambda v: str(v).replace("|", "\\|").replace("`", "'").replace("\n", " ")
        out += ["", f"## {section.replace('_', ' ').capitalize()}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in got[:rows]]
        out += ["", f"Only the first {rows} rows are shown."] if len(got) > rows else []
    return "\n".join(out) + "\n"
