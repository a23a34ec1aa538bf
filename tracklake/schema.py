"""Canonical columns, header aliases and header normalisation. No session is needed."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical column names and their kinds.
DEFAULT_COLUMNS: dict[str, str] = {
    "MMSI": "int",
    "BaseDateTime": "datetime",
    "LAT": "float",
    "LON": "float",
    "SOG": "float",
    "COG": "float",
    "Heading": "float",
    "IMO": "str",
    "CallSign": "str",
    "VesselName": "str",
    "VesselType": "str",
    "Status": "int",
    "Length": "float",
    "Width": "float",
    "Draft": "float",
    "Cargo": "int",
    "TransceiverClass": "str",
}

# Header spellings of each canonical name, after lower-casing and removal of all but letters and digits.
HEADER_KEYS: dict[str, tuple[str, ...]] = {
    "MMSI": ("mmsi", "maritimemobileserviceidentity"),
    "BaseDateTime": ("basedatetime", "timestamp", "datetime", "time", "ts"),
    "LAT": ("lat", "latitude"),
    "LON": ("lon", "long", "lng", "longitude"),
    "SOG": ("sog", "speedoverground"),
    "COG": ("cog", "courseoverground"),
    "Heading": ("heading", "trueheading"),
    "IMO": ("imo", "imonumber"),
    "CallSign": ("callsign",),
    "VesselName": ("vesselname", "shipname"),
    "VesselType": ("vesseltype",),
    "Status": ("status", "navstatus", "navigationstatus"),
    "Length": ("length", "lengthm", "lengthmeters"),
    "Width": ("width", "widthm", "widthmeters"),
    "Draft": ("draft", "draught", "draughtm", "draftm"),
    "Cargo": ("cargo",),
    "TransceiverClass": ("transceiverclass", "transceiver", "aistransceiver", "class"),
}

# Exact vendor names in frames that are already loaded.
ALIASES: dict[str, str] = {
    "Longitude": "LON",
    "Latitude": "LAT",
    "Speed": "SOG",
    "Course": "COG",
    "transceiver": "TransceiverClass",
    "Transceiver": "TransceiverClass",
    "transceiver_class": "TransceiverClass",
    "transceiver class": "TransceiverClass",
}

#: Columns that are numbers in a dataset; the others stay as read.
NUMERIC = {"LAT": "double", "LON": "double", "SOG": "double", "COG": "double", "Draft": "double", "MMSI": "bigint", "IMO": "bigint"}
#: Further columns that are numbers on request.
TYPED = {"Heading": "double", "Length": "double", "Width": "double", "Status": "bigint", "Cargo": "bigint"}

EVENT_SCHEMA = (
    T.StructType()
    .add("type", T.StringType())
    .add("MMSI", T.LongType())
    .add("ts", T.TimestampNTZType())
    .add("delta_deg", T.DoubleType())
    .add("duration_min", T.DoubleType())
    .add("delta_m", T.DoubleType())
    .add("gap_s", T.LongType())
)

_CANONICAL = {key: name for name, keys in HEADER_KEYS.items() for key in keys}


def column_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.strip().lstrip("﻿").strip().lower())


def canonical_names(header: Sequence[str]) -> list[str]:
    """The canonical name of each header field.

    The first field of a meaning gets the name, unless the header has that very
    name elsewhere; other fields keep their own, trimmed. Names that would
    collide, in any case, get a number.
    """
    own = [h.replace("﻿", "").strip() for h in header]
    present, claimed = set(own), set()
    out: list[str] = []
    for name in own:
        target = _CANONICAL.get(column_key(name))
        if target and target not in claimed and (name == target or target not in present):
            claimed.add(target)
            out.append(target)
        else:
            out.append(name)
    seen: set[str] = {n.lower() for n in claimed}
    for i, name in enumerate(out):
        if name in claimed and out.index(name) == i:
            continue
        unique, n = name or f"column_{i}", 1
        while unique.lower() in seen:
            n += 1
            unique = f"{name or 'column'}_{n}"
        seen.add(unique.lower())
        out[i] = unique
    return out


def normalize_header(df: DataFrame) -> DataFrame:
    return df.toDF(*canonical_names(df.columns))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename vendor names of a loaded frame; a canonical column that exists is kept and its alias stays beside it."""
    taken = set(df.columns)
    names: dict[str, str] = {}
    for alias, name in ALIASES.items():
        if alias in df.columns and name not in taken:
            names[alias] = name
            taken.add(name)
    if not names:
        return df
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns))


def available_message(columns: Iterable[str]) -> str:
    names = list(columns)
    return "Available columns: " + ", ".join(names[:40]) + (", ..." if len(names) > 40 else "")


def existing_columns(available: Sequence[str], requested: Iterable[str], extra: Iterable[str] = ()) -> list[str]:
    """Requested columns that exist, then extra ones, each once; an error only if no requested one exists."""
    requested = list(requested)
    found = [c for c in requested if c in available]
    if requested and not found:
        raise ValueError(f"None of the requested columns {requested} exist. {available_message(available)}")
    return list(dict.fromkeys([*found, *(c for c in extra if c in available)]))
