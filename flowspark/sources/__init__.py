"""Sources: a session and a location in, a frame or stream out."""

from .files import list_files, read_csv_records, read_files, read_objects, stream_files  # noqa: F401
from .records import read_changes, read_table_jdbc  # noqa: F401
