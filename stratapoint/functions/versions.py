"""Versions, and what was built in."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint import __version__


def script_version() -> Column:
    return F.lit(__version__)


def lib_version() -> Column:
    return F.lit(__version__)


def engine_version() -> Column:
    """The version of the engine that runs the queries."""
    return F.lit(pyspark.__version__)


def xml_version() -> Column:
    import xml.parsers.expat

    return F.lit(xml.parsers.expat.EXPAT_VERSION)


def geometry_version() -> Column:
    return F.lit(__version__)


def lazperf_enabled() -> Column:
    return F.lit(False)


def version_no_commit(lib: str, script: str) -> str:
    """The common version without its commit; a warning if the two differ."""
    a, b = (v.split(" ")[0] for v in (lib, script))
    if a != b:
        import warnings

        warnings.warn(f"library ({a}) and script version ({b}) mismatch", stacklevel=2)
    return a


def version() -> Column:
    return F.lit(version_no_commit(__version__, __version__))


def full_version() -> Column:
    return F.concat(F.lit("stratapoint lib version: '"), lib_version(), F.lit("' script version: '"), script_version(), F.lit(f"' spark: '{pyspark.__version__}' python: '{platform.python_version()}' expat: '"), xml_version(), F.lit("' lazperf enabled: false"))
