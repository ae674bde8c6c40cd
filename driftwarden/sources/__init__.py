"""Reading and writing flow tables, baselines, reports and models."""
from driftwarden.sources.files import (  # noqa: F401
    FLOW_SCHEMA,
    csv_headers,
    existing_paths,
    read_flow_stream,
    read_flows,
    report_json,
    require_columns,
    skipped_files,
    union_sources,
    write_predictions,
    write_report,
)
from driftwarden.sources.stores import (  # noqa: F401
    load_baseline,
    load_model,
    load_runs,
    save_baseline,
    save_model,
    save_runs,
)
