"""Column functions: every name here takes and returns Spark columns."""

from .envelopes import (  # noqa: F401
    append_step, client_ip, envelope_from_json, envelope_to_json, file_fingerprint, payload_checksum,
    rfc3339, unpacked,
)
from .paths import (  # noqa: F401
    content_type_of, extension_of, glob_regex, match_glob, match_subject, object_key, organize_path,
    render_filename, sanitize, subject_regex,
)
from .retry import backoff_ms, backoff_policy_ms  # noqa: F401
from .versions import in_range, version_key  # noqa: F401
