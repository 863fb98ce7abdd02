"""The read-only SQL console: one SELECT over the given views, checked as text, as a parsed and as an analysed plan before it runs,
with a checked result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits and words of the console.
MAX_CHARS, MAX_ROWS, ID = 20_000, 100_000, "professor_id"
FORBIDDEN = frozenset("INSERT UPDATE DELETE CREATE ALTER DROP PRAGMA ATTACH DETACH VACUUM REINDEX ANALYZE BEGIN COMMIT ROLLBACK SAVEPOINT RELEASE".split())

_TOKEN = re.compile(
    r"""(?P<blank>\s+|--[^\n\r]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<end>;)|(?P<open>/\*|['"`\[])|(?P<other>.)""",
    re.DOTALL,
)


class Refused(ValueError):
    """The statement or its result isn't allowed."""


def guarded(sql: str) -> str:
    """The statement, if it is one SELECT or WITH without a word that changes anything, outside of texts, names and comments."""
    if not isinstance(sql, str) or not sql.strip():
        raise Refused("no statement")
    if len(sql) > MAX_CHARS:
        raise Refused(f"over {MAX_CHARS} characters")
    if "\0" in sql:
        raise Refused("a NUL character")
    first = ended = None
    for token in _TOKEN.finditer(sql):
        kind, text = token.lastgroup, token.group()
        if kind == "blank":
            continue
        if kind == "open":
            raise Refused("an unclosed comment, text or name")
        if ended:
            raise Refused("more than one statement")
        if kind == "end":
            ended = True
        elif kind == "word":
            first = first or text.upper()
            if text.upper() in FORBIDDEN:
                raise Refused(f"{text.upper()} isn't allowed")
        if first not in ("SELECT", "WITH") and not ended:
            raise Refused("only SELECT or WITH")
    if not first:
        raise Refused("no statement")
    return sql


def spark_dialect(sql: str) -> str:
    """Names in brackets or double quotes in back-ticks; no final semicolon."""
    out = []
    for token in _TOKEN.finditer(sql):
        text = token.group()
        if token.lastgroup == "text" and text[0] in '["':
            text = "`" + text[1:-1].replace('""', '"').replace("`", "``") + "`"
        out.append("" if token.lastgroup == "end" else text)
    return "".join(out)


#: Built-in functions that reach beyond the rows.
OUTSIDE = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length version current_user user session_user current_catalog current_database current_schema".split())


def called(sql: str) -> set[str]:
    """Names, of words or in quotes, that stand before an opening bracket."""
    tokens = [(t.lastgroup, t.group()) for t in _TOKEN.finditer(sql) if t.lastgroup != "blank"]
    pairs = zip(tokens, tokens[1:], strict=False)
    return {text.strip('`"[]').lower() for (kind, text), (_, after) in pairs if after == "(" and (kind == "word" or (kind == "text" and text[0] != "'"))}


def confined(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """The statement's result, analysed but not run, if it reads nothing but the views and its own WITH tables and calls
    nothing but Spark's own functions of rows."""
    names = {v.lower() for v in views}
    for name in called(sql):
        try:
            of = spark.catalog.getFunction(name).className
        except Exception:  # noqa: BLE001 - a keyword before a bracket; a function that there isn't fails the analysis
            continue
        if name in OUTSIDE or not of.startswith("org.apache.spark.sql.catalyst."):
            raise Refused(f"{name} isn't allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if "Command" in plan.nodeName() or "Insert" in plan.nodeName():
        raise Refused("only SELECT or WITH")
    tree = plan.treeString()
    own = {n.strip().lower() for found in re.findall(r"CTE \[([^\]]*)\]", tree) for n in found.split(",")}
    read = {n.strip().lower() for n in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", tree)}
    if "TableValuedFunction" in tree or "UnresolvedTVF" in tree or not read <= names | own:
        raise Refused("only the given tables can be read")
    result = spark.sql(sql)
    tree = result._jdf.queryExecution().analyzed().treeString()
    if not {n.lower() for n in re.findall(r"View \(`([^`]*)`", tree)} <= names or re.search(r"SubqueryAlias [^\n.]*\.", tree):
        raise Refused("only the given tables can be read")
    return result


def run(spark: SparkSession, sql: str, views: dict[str, DataFrame], known: DataFrame, most: int | None = MAX_ROWS) -> tuple[DataFrame, int]:
    """The distinct ids of the result, and its number of rows. most: what a reader's screen takes; none for a job
    whose result stays in a table."""
    text = spark_dialect(guarded(sql))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        result = confined(spark, text, views)
    finally:  # what is analysed keeps its plans
        for name in views:
            spark.catalog.dropTempView(name)
    at = [i for i, c in enumerate(result.columns) if c.lower() == ID]
    if len(at) != 1:
        raise Refused(f"exactly one column {ID} is needed")
    ids = result.toDF(*[ID if i == at[0] else f"_{i}" for i in range(len(result.columns))]).select(ID)
    n = (ids if most is None else ids.limit(most + 1)).count()
    if most is not None and n > most:
        raise Refused(f"over {most} rows")
    distinct = ids.distinct()
    if not distinct.join(known.select(F.col(known.columns[0]).alias(ID)), ID, "left_anti").isEmpty():
        raise Refused("unknown ids")
    return distinct, n
