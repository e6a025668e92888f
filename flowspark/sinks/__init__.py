"""Sinks: a frame in, files, tables or deliveries out."""

from .commit import finish_files, write_files_committed  # noqa: F401
from .deliver import deliver, to_bus_records  # noqa: F401
from .files import (  # noqa: F401
    fetch_files, offload_payloads, plan_file_output, resolve_payload_refs, settle_files, write_files,
)
from .http import http_options, http_sender  # noqa: F401
from .keyed import (  # noqa: F401
    apply_to_replica, create_keyed, create_replica, load_replica, manifest, read_keyed, read_replica_table, vacuum, write_keyed,
)
from .tables import (  # noqa: F401
    drop_expired_days, write_archive, write_dead_letter, write_errors, write_table, write_table_jdbc,
)
