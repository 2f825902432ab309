"""Readers and writers for series files and prepared tables."""

from .series import (
    Archive,
    SeriesFile,
    read_archive,
    read_coded_folder,
    read_panel,
    read_series,
    read_series_folder,
)
from .tables import read_table, write_long, write_wide

__all__ = [
    "Archive",
    "read_archive",
    "SeriesFile",
    "read_coded_folder",
    "read_panel",
    "read_series",
    "read_series_folder",
    "read_table",
    "write_long",
    "write_wide",
]
