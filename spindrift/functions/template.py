"""Prompt templates compiled to a column expression.

``$name`` and ``${name}`` stand for columns, ``$$`` for a dollar sign. Values appear as Python prints them: None, True, 1e-05.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.errors import ConfigurationError

MARK = re.compile(r"\$(?:(\$)|([_a-zA-Z][_a-zA-Z0-9]*)|\{([_a-zA-Z][_a-zA-Z0-9]*)\}|())", re.ASCII)
DOTTED = re.compile(r"\{\{\s*(\w+)\.(\w+)\s*\}\}")
#: Types whose text Spark and Python write alike.
ALIKE = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.DecimalType)


class Template:
    """Pieces of a template: texts, and names of columns."""

    def __init__(self, text: str):
        self.pieces: list[tuple[bool, str]] = []  # (is a name, text or name)
        self.fault: str | None = None
        at = 0
        for m in MARK.finditer(text):
            self.pieces.append((False, text[at : m.start()] + ("$" if m[1] else "")))
            name = m[2] or m[3]
            if name:
                self.pieces.append((True, name))
            elif not m[1]:
                line = text.count("\n", 0, m.start()) + 1
                self.fault = self.fault or f"Invalid placeholder in string: line {line}, col {m.start() - (text.rfind(chr(10), 0, m.start()) + 1) + 1}"
            at = m.end()
        self.pieces.append((False, text[at:]))

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(p for is_name, p in self.pieces if is_name))

    def error(self, columns: list[str]) -> str | None:
        """What is wrong for rows of these columns, known before any row is read."""
        missing = [n for n in self.names if n not in columns]
        if missing:
            return f"Missing template variable {missing[0]!r}; there are {', '.join(columns)}"
        return self.fault

    def rendered(self, df: DataFrame) -> Column:
        """The prompt of each row, or null where ``error`` says why there is none."""
        if self.error(df.columns):
            return F.lit(None).cast("string")
        return F.concat(*[python_text(df, piece) if is_name else F.lit(piece) for is_name, piece in self.pieces])


def load_template(path: str | Path) -> Template:
    try:
        return Template(Path(path).read_text())
    except OSError as e:
        raise ConfigurationError(f"no prompt template can be read at {path}: {e}") from e


def dotted(text: str, context: dict[str, str]) -> Template:
    """A template written with ``{{ input.x }}`` for columns and ``{{ context.y }}`` for given texts."""
    out, at = [], 0
    for m in DOTTED.finditer(text):
        out.append(text[at : m.start()].replace("$", "$$"))
        if m[1] == "input":
            out.append(f"${{{m[2]}}}")
        elif m[1] == "context" and m[2] in context:
            out.append(context[m[2]].replace("$", "$$"))
        else:
            raise ConfigurationError(f"the template names {m[1]}.{m[2]}, which isn't given")
        at = m.end()
    return Template("".join([*out, text[at:].replace("$", "$$")]))


def python_text(df: DataFrame, name: str) -> Column:
    """A column's values as ``str`` gives them in Python."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "True").otherwise("False")
        return F.when(column.isNull(), "None").otherwise(text)
    if isinstance(kind, ALIKE):
        return F.coalesce(column.cast("string"), F.lit("None"))
    return _printed(F.struct(column.alias("v")))


@F.arrow_udf(T.StringType())
def _printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts of values that Spark would write another way, such as doubles, lists and structs."""
    for batch in batches:
        yield pa.array([str(v) for v in batch.field(0).to_pylist()], pa.string())
