"""Opening files of the shared folder from Python workers.

Spark names stores by Hadoop's schemes; Arrow's file systems, which the workers
use, know some of them by other names.  Credentials are those that Arrow finds in
the worker's environment.
"""

from __future__ import annotations

import re

import pyarrow.fs

#: Schemes of Hadoop that Arrow has under another name; dbfs:/ is mounted at /dbfs on every node that serves it.
_ARROW_NAMES = {r"s3[an]://": "s3://", r"dbfs:/+": "file:///dbfs/", r"file:/(?=[^/])": "file:///"}


def arrow_uri(uri: str) -> str:
    """``uri`` under the scheme that Arrow knows."""
    for ours, arrow in _ARROW_NAMES.items():
        if re.match(ours, uri):
            return re.sub(ours, arrow, uri, count=1)
    return uri


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path within it; ValueError where Arrow has none for it."""
    try:
        return pyarrow.fs.FileSystem.from_uri(arrow_uri(uri))
    except pyarrow.ArrowInvalid as fault:
        raise ValueError(f"no file system for {uri}: {fault}") from fault
