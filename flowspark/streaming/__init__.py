"""Stateful and windowed streams. Each has a batch twin in ``operators``."""

from .ordered_log import flush_order, order_batch, order_stream, read_ordered  # noqa: F401
from .processors import (  # noqa: F401
    batch_transactions, dedupe_message_stream, ordered_transactions, schedule_retries, track_files, track_messages,
)
from .runs import (  # noqa: F401
    apply_change_stream, for_each_batch_once, read_replica, run_complete, run_to_table, run_until, stream_session,
)
from .windows import flag_batch, flag_stream, rate_batch, rate_stream, read_batches  # noqa: F401
