"""One typed row per log line.

Formats are tried in a fixed order and the first match wins: JSON object, application line,
Android threadtime, Android brief, HTTP access line, and at last "failed". Every input row
gives one output row.

Each pattern runs once per line: ``regexp_replace`` rewrites a matching line into its
captured fields, and a line that comes back unchanged did not match.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.json_fields import (
    first_alias,
    first_nested_alias,
    json_members,
    json_text,
    json_ts,
    last_member_wins,
    nested_objects,
)
from ..functions.timestamps import access_ts, android_ts, app_ts

PARSED_COLUMNS = [
    "timestamp", "level", "service", "message", "raw_line",
    "parse_status", "parse_error", "parse_confidence", "parser_name",
]

_SEP = "\u0000"
# Per format: its pattern, the fields in an order that keeps free text (the only place a
# separator can occur) at the end, and characters without which no line matches.
_REWRITES = [
    ("app", P.APP, ["$1", "$2$4", "$3$5", "$6", "$7", "$8"], ":"),
    ("threadtime", P.THREADTIME, ["$1", "$2", "$3", "$4:$5"], ":."),
    ("brief", P.BRIEF, ["$1", "$2($3"], "/():"),
    ("access", P.ACCESS, ["$3", "$1]$2"], '[]"'),
]


def _after(text: Column, mark: str) -> Column:
    return F.substr(text, F.instr(text, mark) + 1)


_ALIASES = {
    "_ts": P.TS_ALIASES,
    "_level": P.LEVEL_ALIASES,
    "_service": P.SERVICE_ALIASES,
    "_message": P.MESSAGE_ALIASES,
}


def _json_columns(df: DataFrame) -> DataFrame:
    """Add the four fields of JSON lines as ``_ts, _level, _service, _message``; NULL for other lines."""
    df = df.withColumn("_doc", last_member_wins("_doc"))
    df = df.withColumns({name: first_alias("_doc", aliases) for name, aliases in _ALIASES.items()})
    missing = reduce(or_, [F.col(name).isNull() for name in _ALIASES])
    df = df.withColumn("_nested", F.when(missing, nested_objects("_doc")))
    df = df.withColumns(
        {
            name: F.when(F.col(name).isNull(), first_nested_alias("_nested", aliases)).otherwise(F.col(name))
            for name, aliases in _ALIASES.items()
        }
    )
    texts = {f"{name}_text": F.col(name).cast("string") for name in _ALIASES}
    df = df.withColumns({**texts, "_kind": F.schema_of_variant(F.col("_ts"))})
    return df.withColumns(
        {
            "_ts": json_ts(F.col("_ts_text"), F.col("_kind")),
            "_level": F.upper(json_text(F.col("_level"), F.col("_level_text"))),
            "_service": json_text(F.col("_service"), F.col("_service_text")),
            "_message": json_text(F.col("_message"), F.col("_message_text")),
        }
    )


def _status_columns() -> dict[str, Column]:
    """Status, confidence, error and parser name follow from the format and what was found."""
    fmt, has_ts = F.col("_format"), F.col("timestamp").isNotNull()
    found = sum(F.col(c).isNotNull().cast("int") for c in ("timestamp", "level", "service", "message"))
    android = fmt.isin("threadtime", "brief")
    complete = (
        F.when(fmt == "json", found == 4).when(android, has_ts & (F.col("service") != "")).otherwise(has_ts)
    )
    return {
        "parse_status": F.when(fmt.isNull(), "failed").when(complete, "parsed").otherwise("partial"),
        "parse_error": F.when(fmt.isNull(), "No parser matched").when(
            (fmt == "access") & ~has_ts, "access timestamp parse failed"
        ),
        "parse_confidence": F.when(fmt.isNull(), 0.0)
        .when(fmt == "json", F.when(found == 4, 0.95).when(found >= 1, 0.7).otherwise(0.5))
        .when(fmt == "app", F.when(complete, 0.95).otherwise(0.6))
        .when(android, F.when(complete, 0.9).otherwise(0.6))
        .otherwise(F.when(complete, 0.85).otherwise(0.7)),
        "parser_name": F.when(android, "android_v1").otherwise(F.concat(fmt, F.lit("_v1"))),
    }


def normalize(lines: DataFrame, line_col: str = "raw_line", reference_year: int | None = None) -> DataFrame:
    """Replace ``line_col`` by the parsed columns; all other columns are kept.

    ``reference_year`` dates Android lines, which carry none; the default is the current year.
    """
    keep = [c for c in lines.columns if c != line_col]
    line = F.col("raw_line")
    df = lines.select(*keep, F.rtrim(F.col(line_col), F.lit("\n")).alias("raw_line"))

    df = df.withColumn("_docs", F.when(line.startswith("{") | line.rlike(P.JSON_START), json_members(line)))
    df = df.withColumn("_doc", F.when(F.size("_docs") == 1, F.col("_docs")[0])).drop("_docs")
    unmatched = F.col("_doc").isNull()
    for name, pattern, fields, needed in _REWRITES:
        possible = reduce(and_, [F.contains(line, F.lit(c)) for c in needed])
        rewritten = F.regexp_replace(line, pattern, _SEP.join(fields))
        df = df.withColumn(f"_{name}", F.when(unmatched, F.when(possible, rewritten).otherwise(line)))
        unmatched = F.col(f"_{name}") == line

    fmt, fields = F.when(F.col("_doc").isNotNull(), "json"), None
    for name, _, picked, _ in _REWRITES:
        hit = F.col(f"_{name}") != line
        split = F.split(F.col(f"_{name}"), _SEP, len(picked))
        fmt = fmt.when(hit, name)
        fields = F.when(hit, split) if fields is None else fields.when(hit, split)
    df = df.select(*keep, "raw_line", "_doc", fmt.alias("_format"), fields.alias("_fields"))
    df = _json_columns(df)

    fmt, f = F.col("_format"), F.col("_fields")
    levels = F.create_map(*[F.lit(x) for pair in P.ANDROID_LEVELS.items() for x in pair])
    tag = F.when(fmt == "threadtime", F.substring_index(f[3], ":", 1)).otherwise(F.substring_index(f[1], "(", 1))
    android = fmt.isin("threadtime", "brief")
    df = df.withColumns(
        {
            "timestamp": F.when(fmt == "json", F.col("_ts"))
            .when(fmt == "app", app_ts(f[0], f[1], f[2]))
            .when(fmt == "threadtime", android_ts(f[0], f[1], reference_year))
            .when(fmt == "access", access_ts(F.substring_index(f[1], "]", 1))),
            "level": F.when(fmt == "json", F.col("_level"))
            .when(fmt == "app", f[3])
            .when(android, F.element_at(levels, F.when(fmt == "threadtime", f[2]).otherwise(f[0]))),
            "service": F.when(fmt == "json", F.col("_service"))
            .when(fmt == "app", f[4])
            .when(android, F.btrim(tag, F.lit(P.SPACES))),
            "message": F.when(fmt == "json", F.col("_message"))
            .when(fmt == "app", f[5])
            .when(fmt == "threadtime", _after(f[3], ":"))
            .when(fmt == "brief", _after(f[1], "("))
            .when((fmt == "access") & ~f[1].endswith("]"), F.concat(_after(f[1], "]"), F.lit(" -> "), f[0])),
        }
    )
    df = df.withColumns(_status_columns())
    # A filter on a parsed column must stay above the parsing: pushed below, it would parse a line
    # again for every mention of the column. The columns of a generator stop it, and filters on
    # kept columns pass on to the scan.
    return df.select(*keep, F.inline(F.array(F.struct(*PARSED_COLUMNS))))
