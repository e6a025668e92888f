"""A flow: source, steps, destinations. Declared as a dict, run as one plan.

Every message gets a ``route``: a destination, ``rejected`` (invalid), ``dropped`` (filtered out) or
``dead_letter`` (its conversion failed). Later steps leave a message that has a route as it is. Every destination
needs a sink, or None where its messages shall only be counted; rejected messages and dead letters without a sink
are written to the folder ``unsent`` of the flow, by default below the shared folder. The annotated messages are written once, partitioned by route;
each sink then reads its own partition, so parallel destinations never run the plan again; the copy goes when the flow ends.

Deliveries that a sink reports as failed are not lost: with ``retry_dir`` in the config they are entered there, and
``drain_flow`` sends them again until they are delivered or dead letters (see ``retries``).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import converters, filters, messages
from ..session import shared_dir
from ..sinks.storage import exists, open_store
from ..sources.registry import open_source, send_to
from ..streaming.runs import for_each_batch_once
from .retries import Deliver, RetryPolicy, drain_retries, first_deliveries

REJECTED, DROPPED, DEAD_LETTER = "rejected", "dropped", "dead_letter"


def load_config(environ: Mapping[str, str]) -> dict:
    """Source and sink of a flow from the four settings a component is started with."""
    values = {}
    for name in ("INPUT_TYPE", "INPUT_CONFIG", "OUTPUT_TYPE", "OUTPUT_CONFIG"):
        if not environ.get(name):
            raise ValueError(f"{name} is required")
        values[name] = environ[name]
        if name.endswith("_CONFIG"):
            try:
                values[name] = json.loads(environ[name])
            except json.JSONDecodeError as error:
                raise ValueError(f"{name} is not valid JSON: {error}") from error
    return {
        "source": {"type": values["INPUT_TYPE"], "options": values["INPUT_CONFIG"]},
        "steps": [],
        "default": "out",
        "sinks": {"out": {"type": values["OUTPUT_TYPE"], "options": values["OUTPUT_CONFIG"]}},
    }


@dataclass
class Flow:
    """Steps applied to messages still on their way; ``functions`` are user functions by name."""

    steps: list[dict] = field(default_factory=list)
    default: str = "out"
    functions: dict[str, Callable] = field(default_factory=dict)

    def destinations(self) -> set[str]:
        """Routes that steps can choose."""
        found, left = set(), True
        for step in self.steps:
            if step["kind"] == "route" and left:
                found |= {rule["to"] for rule in step["rules"]} | {step.get("default", self.default)}
                left = False  # nothing is without a route behind it
        if left:
            found.add(self.default)
        return found

    def annotate(self, env: DataFrame) -> DataFrame:
        df = env.withColumn("route", F.lit(None).cast("string"))
        for step in self.steps:
            df = self._apply(df, step)
        return df.withColumn("route", F.coalesce("route", F.lit(self.default)))

    def _apply(self, df: DataFrame, step: dict) -> DataFrame:
        kind = step["kind"]
        if kind == "validate":
            reason = filters.reject_reason(**step.get("options", {}))
            return self._divert(df, reason.isNotNull(), REJECTED, reason)
        if kind == "validate_payload":
            checked = filters.validate_payload(df, step["schema"])
            return self._divert(checked, F.size("payload_errors") > 0, REJECTED,
                                F.array_join("payload_errors", "; ")).drop("payload_errors")
        if kind == "map_json":
            return self._converted(df, lambda env: converters.map_json(env, step["mapping"]))
        if kind in ("json_to_xml", "xml_to_json"):
            change = getattr(converters, kind)
            return self._converted(df, lambda env: change(env, step["schema"], step.get("row_tag", "ROW")))
        if kind == "convert":
            done = converters.apply_converter(df.withColumn("__done", F.col("route").isNotNull()),
                                              self.functions[step["function"]], config=step.get("config"), skip="__done")
            return self._divert(done, F.col("failed"), DEAD_LETTER, F.col("last_error")).drop("failed", "__done")
        if kind == "filter":
            passes = filters.field_condition(step["path"], step["op"], step.get("value"))
            return self._divert(df, ~passes, DROPPED, F.lit(None).cast("string"))
        if kind == "step":
            return self._on_the_way(df, lambda env: messages.append_step(env, step["name"]))
        if kind == "route":
            chosen = filters.route_fields(
                df.withColumn("__held", F.col("route")), step["rules"], step.get("default", self.default))
            return chosen.withColumn("route", F.coalesce("__held", "route")).drop("__held")
        raise ValueError(f"unknown step: {kind}")

    @staticmethod
    def _on_the_way(df: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``change`` for messages without a route; the others keep all their columns."""
        kept = df.select("*", F.struct(*df.columns).alias("__before"))
        changed = change(kept)
        return changed.select(*[
            F.when(F.col("route").isNull(), F.col(name)).otherwise(F.col(f"__before.{name}")).alias(name)
            if name in df.columns else F.col(name) for name in changed.columns if name != "__before"])

    def _converted(self, df: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A conversion; a payload it can't read makes its message a dead letter."""
        done = self._on_the_way(df, change)
        return self._divert(done, F.col("conversion_error").isNotNull(), DEAD_LETTER, F.col("conversion_error")).drop(
            "conversion_error")

    @staticmethod
    def _divert(df: DataFrame, condition: Column, to: str, reason: Column) -> DataFrame:
        hit = F.col("route").isNull() & F.coalesce(condition, F.lit(False))
        return df.withColumns({
            "last_error": F.when(hit, F.coalesce(reason, "last_error")).otherwise(F.col("last_error")),
            "route": F.when(hit, F.lit(to)).otherwise(F.col("route")),
        })


def _checked(config: dict, functions: dict[str, Callable] | None) -> Flow:
    """The flow of a config whose destinations all have a sink (or None)."""
    flow = Flow(config.get("steps", []), config.get("default", "out"), functions or {})
    missing = sorted(flow.destinations() - set(config.get("sinks", {})))
    if missing:
        raise ValueError(f"no sink for route: {', '.join(missing)}")
    return flow


def _send_routes(
    staged: DataFrame, config: dict, unsent: str, batch: int | None = None, as_of: Column | None = None,
) -> None:
    sinks, retry_dir = config.get("sinks", {}), config.get("retry_dir")
    for destination, sink in sinks.items():
        if sink is not None:
            part = staged.filter(F.col("route") == destination).drop("route")
            report = send_to(part, sink["type"], {**sink.get("options", {}), **({} if batch is None else {"batch": batch})})
            if report is not None and retry_dir:
                first_deliveries(part, report, retry_dir, destination, policy=RetryPolicy(**config.get("retry", {})),
                                 as_of=F.current_timestamp() if as_of is None else as_of)
    rest = [route for route in (REJECTED, DEAD_LETTER) if route not in sinks]
    if rest:
        place = unsent if batch is None else f"{unsent}/batch={batch}"
        staged.filter(F.col("route").isin(rest)).write.mode("overwrite").partitionBy("route").parquet(place)


def deliveries(config: dict) -> dict[str, Deliver]:
    """For each destination how it is sent to again; a pass has a report of its own."""
    def again(sink: dict) -> Deliver:
        def send(env: DataFrame, destination: str, number: int) -> DataFrame:
            options = dict(sink.get("options", {}))
            if options.get("report_path"):
                options["report_path"] = f"{options['report_path'].rstrip('/')}-pass={number}"
            report = send_to(env, sink["type"], options)
            if report is None:
                raise ValueError(f"the sink of {destination} reports no deliveries")
            return report
        return send

    return {name: again(sink) for name, sink in config.get("sinks", {}).items() if sink is not None}


def drain_flow(
    spark: SparkSession, config: dict, *, wait: Callable[[datetime], Column] | None = None, dead_dir: str | None = None,
) -> DataFrame | None:
    """Sends a flow's failed deliveries again until each is delivered or a dead letter; returns the last states."""
    def sleep(moment: datetime) -> Column:
        time.sleep(max(0.0, moment.timestamp() - time.time()))
        return F.current_timestamp()

    return drain_retries(spark, config["retry_dir"], deliveries(config), wait=wait or sleep, dead_dir=dead_dir,
                         policy=RetryPolicy(**config.get("retry", {})))


def _stage(annotated: DataFrame, path: str) -> DataFrame:
    annotated.write.mode("overwrite").partitionBy("route").parquet(path)
    return annotated.sparkSession.read.schema(annotated.schema).parquet(path)


def _cleared(path: str) -> None:
    """Removes a stage that nothing reads any more."""
    store, root = open_store(path)
    if exists(store, root):
        store.delete_dir(root)


def run_flow(
    spark: SparkSession, config: dict, *, functions: dict[str, Callable] | None = None, stage_dir: str | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Runs a declared flow to its end; returns messages and bytes per route. ``as_of`` is the time of its deliveries.

    The stage is removed at the end unless ``stage_dir`` was given.
    """
    source, flow = config["source"], _checked(config, functions)
    env = open_source(spark, source["type"], source.get("options", {}))
    stage = stage_dir or shared_dir(spark, "flow")
    staged = _stage(flow.annotate(env), stage)
    _send_routes(staged, config, config.get("unsent") or shared_dir(spark, "unsent"), as_of=as_of)
    report = staged.groupBy("route").agg(F.count(F.lit(1)).alias("messages"), F.sum("payload_size").alias("total_bytes"))
    if stage_dir:
        return report
    rows = report.collect()  # a row a route
    _cleared(stage)
    return spark.createDataFrame(rows, report.schema)


def run_flow_stream(
    stream: DataFrame, config: dict, stage_dir: str, checkpoint: str, *,
    functions: dict[str, Callable] | None = None, **trigger
):
    """The same flow over a stream of messages. Each micro-batch is staged under its id and sent once.

    Built-in sinks write a folder ``batch=<id>`` for each micro-batch; other sinks get the option ``batch``.
    """
    flow = _checked(config, functions)
    unsent = config.get("unsent") or f"{stage_dir}/unsent"

    def handle(batch: DataFrame, batch_id: int) -> None:
        stage = f"{stage_dir}/batch={batch_id}"
        _send_routes(_stage(flow.annotate(batch), stage), config, unsent, batch_id)
        _cleared(stage)

    return for_each_batch_once(stream, handle, checkpoint, **trigger)
