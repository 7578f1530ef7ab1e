"""File sources, sinks and the fixed input schemas of the programs."""

from minekit.sources.files import (
    output_path,
    read_csv,
    read_headerless,
    read_routed,
    write_csv,
    write_routed,
    write_text,
)

__all__ = [
    "output_path",
    "read_csv",
    "read_headerless",
    "read_routed",
    "write_csv",
    "write_routed",
    "write_text",
]
