"""Messages to files, files to their archive, large payloads to a store."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import organize_path, payload_checksum, render_filename
from ..functions.envelopes import FINGERPRINT_BYTES
from ..functions.paths import key_part
from ..operators.filters import reject_reason
from ..schema import INLINE_PAYLOAD_LIMIT, MAX_PAYLOAD_BYTES
from .storage import exists, get, head, moved, open_store, put

FETCHED_BYTES = 64 * 1024 * 1024


def plan_file_output(
    env: DataFrame, template: str = "{{.ID}}.{{.Extension}}", *, organize_by: str = "none", subfolders: bool = True,
    max_size: int = MAX_PAYLOAD_BYTES,
) -> DataFrame:
    """Adds where each message goes (``rel_path``), its ``checksum``, or why not (``reject_reason``)."""
    name = render_filename(template)
    folder = organize_path(organize_by, enabled=subfolders)
    path = F.concat_ws("/", F.nullif(folder, F.lit("")), name)
    # Names hold no slash, so only a name or folder made of dots could leave the root.
    escapes = name.isin(".", "..") | folder.isin(".", "..")
    reason = F.coalesce(reject_reason(max_size), F.when(name.isNull(), "empty_name"),
                        F.when(escapes, "path_traversal"))
    return env.withColumn("reject_reason", reason).withColumns({
        "rel_path": F.when(F.col("reject_reason").isNull(), path),
        "checksum": F.when(F.col("reject_reason").isNull(), payload_checksum()),
    })


def latest_per_path(plan: DataFrame) -> DataFrame:
    """Keeps the newest message of each path, for templates that do not tell messages apart.

    Winners are found without the payloads, which are then not shuffled when winners are few.
    """
    return plan.join(_newest(plan), ["rel_path", "id"], "left_semi")


def _newest(plan: DataFrame) -> DataFrame:
    """Path and id of the newest message of each path."""
    age = ["created_at"] if "created_at" in plan.columns else []
    return (plan.groupBy("rel_path").agg(F.max(F.struct(*age, "id")).alias("__last"))
            .select("rel_path", F.col("__last.id").alias("id")))


def write_files(plan: DataFrame, out_dir: str, *, report_dir: str | None = None) -> DataFrame:
    """Writes one file per accepted message of a plan; returns what was written.

    Runs at once. A task that is run again writes the same content to the same names. Of several messages for
    one path the newest is written; the others are reported with ``bytes`` NULL.
    """
    accepted = plan.filter(F.col("reject_reason").isNull())
    winners = _newest(accepted).withColumn("__newest", F.lit(True))
    told = accepted.select("id", "rel_path", "payload", "checksum").join(winners, ["rel_path", "id"], "left")
    rows = told.select("id", "rel_path", F.when(F.col("__newest"), F.col("payload")).alias("payload"), "checksum",
                       F.coalesce("__newest", F.lit(False)).alias("newest"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(out_dir)
        for batch in batches:
            sizes = []
            for path, payload, newest in zip(batch.column("rel_path"), batch.column("payload"), batch.column("newest")):
                if not newest.as_py():
                    sizes.append(None)
                    continue
                content = payload.as_py()
                put(store, f"{root}/{path.as_py()}", content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rel_path"), pa.array(sizes, pa.int64()), batch.column("checksum")],
                names=["id", "rel_path", "bytes", "checksum"])

    report = rows.mapInArrow(write, "id string, rel_path string, bytes bigint, checksum string")
    return _reported(report, report_dir or f"{out_dir.rstrip('/')}/_reports/{uuid.uuid4().hex}")


def _reported(report: DataFrame, path: str) -> DataFrame:
    """Runs a frame that has side effects exactly as one write, and reads its rows from there."""
    report.write.mode("overwrite").parquet(path)
    return report.sparkSession.read.schema(report.schema).parquet(path)


def settle_files(
    files: DataFrame, *, as_of: Column, archive_dir: str | None = None, error_dir: str | None = None,
    delete: bool = False, report_dir: str,
) -> DataFrame:
    """Moves or removes source files after processing: rows (path, error), ``error`` NULL on success.

    Success goes to ``archive_dir/YYYY-MM-DD/``, is deleted, or stays. Failure goes to
    ``error_dir/YYYY-MM-DD/`` with a ``.error`` file beside it. A file already moved by an earlier try of
    the task counts as done.
    """
    day, now = F.date_format(as_of, "yyyy-MM-dd"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = files.select("path", "error", day.alias("day"), now.alias("now"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                name = posixpath.basename(path)
                failed = row["error"] is not None
                folder = error_dir if failed else None if delete else archive_dir
                action, place = "left", None
                if folder:
                    _, root = open_store(folder)
                    place = f"{root}/{row['day']}/{name}"
                    moved(store, path, place)
                    if failed:
                        note = f"timestamp={row['now']}\nerror={row['error']}\n"
                        put(store, f"{place}.error", note.encode())
                    action = "error" if failed else "archived"
                elif delete and not failed:
                    if exists(store, path):
                        store.delete_file(path)
                    action = "deleted"
                out.append({"path": row["path"], "action": action, "moved_to": place})
            yield pa.RecordBatch.from_pylist(
                out, schema=pa.schema([("path", pa.string()), ("action", pa.string()), ("moved_to", pa.string())]))

    return _reported(rows.mapInArrow(settle, "path string, action string, moved_to string"), report_dir)


def fetch_files(listing: DataFrame, *, batch_bytes: int = FETCHED_BYTES, known: str | None = None) -> DataFrame:
    """Adds ``content`` of the file at ``path``, or the ``error`` that kept it from being read.

    Each file is read by the task that holds its row; an unreadable file fails its row only. ``known`` names a column with the
    digest that the head of an unchanged file has: such a file is read no further, ``unchanged`` is true and it has no content.
    """
    schema = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType()),
                           T.StructField("error", T.StringType()), *([T.StructField("unchanged", T.BooleanType())] if known else [])])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, contents, errors, same, held = 0, [], [], [], 0
            digests = batch.column(known).to_pylist() if known else [None] * batch.num_rows
            for position, (path, digest) in enumerate(zip(batch.column("path").to_pylist(), digests)):
                content, error, unchanged = None, None, False
                try:
                    store, place = open_store(path)
                    unchanged = digest is not None and hashlib.sha256(head(store, place, FINGERPRINT_BYTES)).hexdigest() == digest
                    content = None if unchanged else get(store, place)
                except OSError as failure:
                    error = f"{type(failure).__name__}: {failure}"
                contents.append(content)
                errors.append(error)
                same.append(unchanged)
                held += len(content or b"")
                if held >= batch_bytes or position + 1 == batch.num_rows:
                    part = batch.slice(begun, len(contents))
                    found = [pa.array(contents, pa.binary()), pa.array(errors, pa.string()), pa.array(same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *found[:2 + bool(known)]], names=schema.names)
                    begun, contents, errors, same, held = position + 1, [], [], [], 0

    return listing.mapInArrow(fetch, schema)


def offload_payloads(
    env: DataFrame, store: str, *, threshold: int = INLINE_PAYLOAD_LIMIT, report_dir: str | None = None
) -> DataFrame:
    """Moves payloads above ``threshold`` to ``store``/{tenant}/messages/{id}.bin and keeps a reference.

    What flows on is small: later shuffles carry references instead of payloads.
    """
    large = F.coalesce(F.octet_length("payload") > threshold, F.lit(False))
    key = F.concat_ws("/", key_part(F.nullif("tenant_id", F.lit(""))), F.lit("messages"),
                      F.concat(key_part(F.col("id")), F.lit(".bin")))
    plan = env.filter(large).select("id", "payload", key.alias("rel_path"), payload_checksum().alias("checksum"),
                                    F.lit(None).cast("string").alias("reject_reason"))
    write_files(plan, store, report_dir=report_dir)
    return env.withColumns({
        "payload_ref": F.when(large, F.concat(F.lit(store.rstrip("/") + "/"), key)).otherwise(F.col("payload_ref")),
        "payload_size": F.when(large, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_size")),
        "payload": F.when(~large, F.col("payload")),
    })


def resolve_payload_refs(env: DataFrame, store: str, *, batch_bytes: int = FETCHED_BYTES) -> DataFrame:
    """Puts payloads referenced below ``store`` back inline, each fetched by the task that holds its message.

    Nothing is listed or shuffled. A reference to a missing object, or to a place outside the store, stays.
    """
    prefix = store.rstrip("/") + "/"
    key = F.substring("payload_ref", F.lit(len(prefix) + 1), F.length("payload_ref"))
    within = F.coalesce(F.startswith(F.col("payload_ref"), F.lit(prefix))
                        & ~F.array_contains(F.split(key, "/"), ".."), F.lit(False))
    ref, size = env.columns.index("payload_ref"), env.columns.index("payload_size")
    inline = env.columns.index("payload")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_store(store)

        def filled(batch: pa.RecordBatch, payloads: list[bytes | None]) -> pa.RecordBatch:
            columns = list(batch.columns)
            refs = columns[ref].to_pylist()
            columns[inline] = pa.array(payloads, pa.binary())
            columns[ref] = pa.array([None if payload is not None else r for r, payload in zip(refs, payloads)],
                                    pa.string())
            columns[size] = pa.array([len(payload) if payload is not None else s for s, payload in zip(
                columns[size].to_pylist(), payloads)], pa.int64())
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        for batch in batches:
            begun, payloads, held = 0, [], 0
            for position, reference in enumerate(batch.column(ref).to_pylist()):
                path = f"{root.rstrip('/')}/{reference[len(prefix):]}"
                payloads.append(get(files, path) if exists(files, path) else None)
                held += len(payloads[-1] or b"")
                if held >= batch_bytes or position + 1 == batch.num_rows:
                    yield filled(batch.slice(begun, len(payloads)), payloads)
                    begun, payloads, held = position + 1, [], 0

    return env.filter(~within).unionByName(env.filter(within).mapInArrow(fetch, env.schema))
