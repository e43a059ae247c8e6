"""What a sink expects of the stream that is sent to it."""

from __future__ import annotations

from collections.abc import Collection, Mapping


def check_warehouse_fields(fields: Collection[str], columns: Mapping[str, str]) -> None:
    """A warehouse sink takes exactly the fields of its column map."""
    if set(fields) != set(columns):
        raise ValueError(f"stream has fields {sorted(fields)}, the table takes {sorted(columns)}")


def check_title(fields: Collection[str], title: str | None) -> None:
    """The title field of a bucket sink, if any, must be in the stream."""
    if title is not None and title not in fields:
        raise ValueError(f"title field {title!r} is not in the stream {sorted(fields)}")
