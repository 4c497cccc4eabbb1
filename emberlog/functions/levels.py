"""Spellings of levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import LEVELS

# Wire codes, lenient spellings and glyphs of the levels.
CODES = {"Info": 0, "Warning": 1, "Error": 2, "FatalError": 3, "Debug": 4}
WIRE_NAMES = {"Info": "Info", "Warning": "Warning", "Error": "Error", "FatalError": "Fatal", "Debug": "Debug"}
LENIENT = {"info": "Info", "warning": "Warning", "warn": "Warning", "error": "Error", "fatalerror": "FatalError", "fatal": "FatalError", "debug": "Debug"}
GLYPHS = {"Info": "☑", "Warning": "⚠️Warning", "Error": "🟥Error", "FatalError": "☠️FatalError", "Debug": "🪲Debug"}


def parse_level(text: str) -> str:
    """A level from its lenient spelling; ValueError for anything else."""
    found = LENIENT.get(text.strip().lower())
    if found is None:
        raise ValueError(f"unknown log level {text!r}; expected one of {', '.join(LEVELS)}")
    return found


def _mapped(col: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col]


def level_code(level: Column) -> Column:
    return _mapped(level, CODES)


def level_of_code(code: Column) -> Column:
    return _mapped(code, {v: k for k, v in CODES.items()})


def wire_name(level: Column) -> Column:
    return _mapped(level, WIRE_NAMES)


def glyph(level: Column) -> Column:
    return _mapped(level, GLYPHS)


def seq_level(name: Column) -> Column:
    """Level of a Seq record: four exact names, anything else or none is fatal."""
    return F.when(name.isin("Info", "Warning", "Error", "Debug"), name).otherwise("FatalError")
