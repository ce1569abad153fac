"""Type alignment of the SQL twins (see registry.Query.oracle)."""

# DuckDB returns HUGEINT for count_if and integer sums, BIGINT for row_number/length,
# DECIMAL for decimal sums and literals and JSON for to_json. The twins of these queries
# cast those columns to the type the Spark query returns (values are unchanged).
ORACLE_CASTS: dict[str, dict[str, str]] = {
    "missing_by_column": {'n_missing': 'BIGINT'},
    "missing_by_column_lineitem": {'n_missing': 'BIGINT'},
    "describe_numeric": {'n_missing': 'BIGINT'},
    "describe_quantity_by_flag": {'n_missing': 'BIGINT'},
    "summary_overview": {'n_missing': 'BIGINT'},
    "boxplot_stats": {'n_out_low': 'BIGINT', 'n_out_high': 'BIGINT'},
    "bar_order": {'bar_pos': 'INTEGER'},
    "top_customers_per_nation": {'rank': 'INTEGER'},
    "task_counters": {'remaining': 'BIGINT', 'overdue': 'BIGINT'},
    "profile": {'n_missing': 'BIGINT'},
    "week_on_week": {'total': 'DOUBLE', 'previous': 'DOUBLE'},
    "prompt_audit": {'n_with_output': 'BIGINT', 'n_with_template': 'BIGINT', 'n_decision_facing': 'BIGINT', 'n_unreviewed_decisions': 'BIGINT'},
    "segment_customers": {'recency_days': 'INTEGER'},
    "feedback_tracking": {'n_open': 'BIGINT', 'n_closed': 'BIGINT'},
    "store_kpis": {'low_stock': 'BIGINT', 'sold_out': 'BIGINT', 'open_orders': 'BIGINT'},
    "related_rows": {'child_row': 'VARCHAR'},
    "customer_360": {'child_row': 'VARCHAR'},
    "kpi_volume": {'ai': 'BIGINT', 'human': 'BIGINT'},
    "kpi_compliance": {'compliance_events': 'BIGINT', 'critical_failures': 'BIGINT'},
    "kpi_vs_target": {'target': 'DOUBLE'},
    "rebuild_multiline": {'msg_no': 'BIGINT'},
    "chat_export_messages": {'msg_no': 'BIGINT'},
    "flag_system": {'msg_no': 'BIGINT'},
    "message_features": {'msg_no': 'BIGINT', 'n_words': 'INTEGER', 'n_chars': 'INTEGER', 'n_emojis': 'INTEGER', 'n_urls': 'INTEGER', 'hour': 'INTEGER', 'weekday': 'INTEGER'},
    "response_times": {'msg_no': 'BIGINT'},
    "chat_totals": {'words': 'BIGINT', 'links': 'BIGINT', 'media': 'BIGINT', 'emojis': 'BIGINT'},
    "active_participants": {'rank': 'INTEGER'},
    "activity_map": {'weekday': 'INTEGER', 'h00': 'BIGINT', 'h01': 'BIGINT', 'h02': 'BIGINT', 'h03': 'BIGINT', 'h04': 'BIGINT', 'h05': 'BIGINT', 'h06': 'BIGINT', 'h07': 'BIGINT', 'h08': 'BIGINT', 'h09': 'BIGINT', 'h10': 'BIGINT', 'h11': 'BIGINT', 'h12': 'BIGINT', 'h13': 'BIGINT', 'h14': 'BIGINT', 'h15': 'BIGINT', 'h16': 'BIGINT', 'h17': 'BIGINT', 'h18': 'BIGINT', 'h19': 'BIGINT', 'h20': 'BIGINT', 'h21': 'BIGINT', 'h22': 'BIGINT', 'h23': 'BIGINT'},
    "rank_evidence": {'rank': 'INTEGER'},
    "library_catalog": {'total_chars': 'BIGINT'},
    "classify_links": {'anchor_no': 'INTEGER'},
    "routable_links": {'anchor_no': 'INTEGER'},
    "dead_links": {'anchor_no': 'INTEGER'},
    "churn_features": {'label': 'DOUBLE'},
    "argmax_class": {'class_idx': 'BIGINT'},
    "rdd_estimate": {'n_left': 'BIGINT', 'n_right': 'BIGINT'},
    "incidence_rates": {'cases': 'BIGINT'},
    "recommend_popular": {'rank': 'INTEGER'},
    "forecast_scenarios": {'factor': 'DOUBLE'},
    "root_causes": {'affected_rows': 'BIGINT', 'cause_rank': 'INTEGER'},
}
