"""Runs the flow described by INPUT_TYPE, INPUT_CONFIG, OUTPUT_TYPE and OUTPUT_CONFIG."""

import os

from flowspark import build_session
from flowspark.plans import load_config, run_flow

if __name__ == "__main__":
    run_flow(build_session(), load_config(os.environ)).show(truncate=False)
