"""Whole flows, declared and run."""

from .connectors import register_builtin
from .flow import Flow, deliveries, drain_flow, load_config, run_flow, run_flow_stream  # noqa: F401
from .folders import file_sink_options, file_source_options, poll_folder, watch_folder  # noqa: F401
from .orders import order_messages, order_workflow  # noqa: F401
from .retries import RetryPolicy, drain_retries, retry_log, retry_pass, retry_states  # noqa: F401

register_builtin()
