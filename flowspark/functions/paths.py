"""Names: MIME types, file names, object keys, globs and subjects."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column, functions as F

# MIME type of a file extension.
MIME_BY_EXTENSION = {
    ".json": "application/json",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".xml": "application/xml",
    ".yaml": "application/yaml",
    ".yml": "application/yaml",
    ".pdf": "application/pdf",
    ".html": "text/html",
    ".css": "text/css",
    ".js": "application/javascript",
    ".zip": "application/zip",
}
UNKNOWN_MIME = "application/octet-stream"

# Extension of a MIME type, first entry contained in the type wins.
EXTENSION_BY_MIME = [
    ("application/json", "json"),
    ("text/plain", "txt"),
    ("text/csv", "csv"),
    ("application/xml", "xml"),
    ("application/yaml", "yaml"),
    ("text/yaml", "yaml"),
]
UNKNOWN_EXTENSION = "bin"

# Characters that never appear in a file name.
UNSAFE_CHARACTERS = "/\\:*?\"<>|\n\r\0"


def content_type_of(path: Column, system_types: dict[str, str] | None = None) -> Column:
    """MIME type by extension; ``system_types`` (by default those Python knows) don't replace the fixed ones."""
    known = mimetypes.MimeTypes(filenames=()).types_map[True] if system_types is None else system_types
    table = {**known, **MIME_BY_EXTENSION}
    lookup = F.create_map(*[F.lit(cell) for row in table.items() for cell in row])
    extension = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.coalesce(F.try_element_at(lookup, extension), F.lit(UNKNOWN_MIME))


def extension_of(content_type: Column) -> Column:
    (mime, extension), *others = EXTENSION_BY_MIME
    chain = F.when(F.contains(content_type, F.lit(mime)), extension)
    for mime, extension in others:
        chain = chain.when(F.contains(content_type, F.lit(mime)), extension)
    return chain.otherwise(UNKNOWN_EXTENSION)


def sanitize(name: Column) -> Column:
    return F.translate(name, UNSAFE_CHARACTERS, "_" * len(UNSAFE_CHARACTERS))


def render_filename(
    template: str = "{{.ID}}.{{.Extension}}",
    *,
    id: Column | None = None,
    source: Column | None = None,
    content_type: Column | None = None,
    created_at: Column | None = None,
) -> Column:
    """File name from a ``{{.Name}}`` template, NULL where nothing is left of it.

    The template is split on the driver; what runs is one ``concat``.
    """
    variables = {
        "ID": F.coalesce(id if id is not None else F.col("id"), F.lit("")),
        "Source": sanitize(F.coalesce(source if source is not None else F.col("source"), F.lit(""))),
        "Extension": extension_of(content_type if content_type is not None else F.col("content_type")),
        "Timestamp": F.concat(
            F.date_format(created_at if created_at is not None else F.col("created_at"),
                          "yyyy-MM-dd'T'HH:mm:ss"),
            F.lit("Z")),
    }
    pieces = re.split(r"\{\{\s*\.(\w+)\s*\}\}", template)
    columns = [
        variables.get(piece, F.lit("<no value>")) if position % 2 else F.lit(piece)
        for position, piece in enumerate(pieces) if position % 2 or piece
    ]
    return F.nullif(sanitize(F.concat(F.lit(""), *columns)), F.lit(""))


def organize_path(
    strategy: str = "none",
    *,
    enabled: bool = True,
    content_type: Column | None = None,
    source: Column | None = None,
    created_at: Column | None = None,
) -> Column:
    """Sub-folder of a message: by ``type``, ``date``, ``source``, or none."""
    if not enabled or strategy not in ("type", "date", "source"):
        return F.lit("")
    if strategy == "date":
        return F.date_format(created_at if created_at is not None else F.col("created_at"), "yyyy/MM/dd")
    if strategy == "type":
        value = content_type if content_type is not None else F.col("content_type")
        return sanitize(F.translate(_known(value), "/", "-"))
    return sanitize(_known(source if source is not None else F.col("source")))


def _known(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def key_part(value: Column) -> Column:
    """One part of an object's key: different values give different parts, and none leaves its folder."""
    encoded = F.url_encode(value)
    return F.when(encoded.rlike(r"^\.+$"), F.replace(encoded, F.lit("."), F.lit("%2E"))).otherwise(encoded)


def object_key(tenant_id: Column, id: Column, prefix: str = "temp") -> Column:
    return F.concat_ws("/", F.lit(prefix), key_part(tenant_id), F.lit("messages"), F.concat(key_part(id), F.lit(".bin")))


def subject_regex(pattern: str) -> str:
    """Anchored regex of a dotted subject pattern: ``*`` is one token, a final ``>`` the rest."""
    tokens = pattern.split(".")
    if ">" in tokens[:-1]:
        raise ValueError(f"'>' must be the last token: {pattern}")
    parts = {"*": r"[^.]+", ">": r".+"}
    return "^" + r"\.".join(parts.get(token, _quote(token)) for token in tokens) + "$"


def match_subject(subject: Column, pattern: str) -> Column:
    return subject.rlike(subject_regex(pattern))


def glob_regex(pattern: str, one: str = "[^/]") -> str:
    """Anchored regex of a glob with ``*``, ``?``, ``[set]``, ``[^set]`` and escapes.

    ``one`` is what ``?`` and each character of ``*`` may be.
    """
    token = re.compile(r"\*|\?|\[(\^?)((?:\\.|[^\]\\])+)\]|\\(.)|(.)", re.S)
    out, at = "", 0
    while at < len(pattern):
        found = token.match(pattern, at)
        if found is None or found[0] == "[":
            raise ValueError(f"bad glob: {pattern}")
        negated, members, escaped, plain = found.groups()
        if found[0] == "*":
            out += f"{one}*"
        elif found[0] == "?":
            out += one
        elif members is not None:
            out += f"[{negated}{members.replace('[', chr(92) + '[').replace('&&', chr(92) + '&&')}]"
        else:
            out += _quote(escaped or plain)
        at = found.end()
    return f"(?s)^{out}$"


def match_glob(path: Column, pattern: str) -> Column:
    """Whether the last element of ``path`` matches the glob."""
    return F.substring_index(path, "/", -1).rlike(glob_regex(pattern))


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)
