"""Operators: frame in, frame out."""

from .catalog import (  # noqa: F401
    active_only, assign_instances, capacity_status, integration_catalog, latest_version, orphans,
    place_integrations, quota_usage, with_context,
)
from .changes import (  # noqa: F401
    apply_changes, batch_number, change_images, group_by_operation, group_transactions, last_change, merge_rows,
)
from .converters import (  # noqa: F401
    apply_converter, changes_to_envelopes, convert_types, convert_with, converted_and_failed, csv_to_json, decide_with,
    enrich, filter_with,
    json_to_xml, map_json, with_payload, xml_to_json,
)
from .filters import (  # noqa: F401
    allow_list, assert_isolated, drop_expired, drop_settling, field_condition, filter_changes, filter_field,
    filter_pass_drop, for_tenant, json_field, match_glob, match_subject, payload_errors, reject_reason, route,
    route_fields, route_many, split, validate_envelopes, validate_payload,
    with_json_fields, without_json_fields,
)
from .messages import (  # noqa: F401
    append_step, bus_to_envelopes, files_to_envelopes, merge_sources, new_envelope, requests_to_envelopes,
)
from .metrics import (  # noqa: F401
    bucket_totals, delivery_quality, integration_stats, message_rate, rate_limit_flags, status_counts,
    stream_rate_limit_flags, sustained_alert, sustained_rate, top_by_size,
)
from .ordered import exact_quantiles, ordered_scan  # noqa: F401
from .retention import (  # noqa: F401
    audit_trail, expired_archive_days, expired_objects, purge_archives, purge_completed, purge_dead_letters,
    remap_tenant, replay,
)
from .state import dedupe_files, dedupe_messages, mark_duplicates, latest_state, retry_history  # noqa: F401
