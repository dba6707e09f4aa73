"""Ad-hoc read-only SQL over the stores.

The text runs in a session of its own.  Its temporary views are the given
ones and no others, its functions lack those that call into Java, files
cannot be named as tables there, and its settings are its own, so neither
the caller's views nor its settings change while other threads run.

The text is never executed as given: it is wrapped as the body of a derived
table, ``SELECT * FROM (\\n<text>\\n) AS q``.  Spark's parser accepts only a
query there, so INSERT, DROP, CREATE, a second statement or any command fails
while parsing, before anything runs.  The newlines keep a trailing ``--``
comment from swallowing the closing parenthesis.

What is left is checked on the *resolved* plan, after ``IDENTIFIER`` and
every name are looked up: each leaf is a given view or a relation that holds
no stored data, and each expression is one of Spark's own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.vectors import register_sql_functions
from ..session import configure

#: Functions that call any static Java method, or read what is not data.
#: They are taken out of the session, so that not even a name that is
#: computed while the query is resolved (``IDENTIFIER``) can reach them.
REMOVED = ("reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start",
           "input_file_block_length")

#: Leaves of a resolved plan that hold no stored data.
FREE_LEAVES = {"OneRowRelation", "Range", "LocalRelation", "CTERelationRef", "EmptyRelation"}

#: Packages of Spark's own expressions, and classes in them that are refused.
EXPRESSIONS = "org.apache.spark.sql.catalyst."
REFUSED = {"CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
           "ScalaUDF", "PythonUDF", "StaticInvoke", "Invoke", "NewInstance"}


class ReadOnlyError(ValueError):
    """The query reaches beyond the given views."""


def isolated(spark: SparkSession, views: Mapping[str, DataFrame]) -> SparkSession:
    """A session whose only temporary views are ``views``."""
    for name in views:
        if not name.isidentifier():
            raise ValueError(f"bad view name {name!r}")
    own = configure(spark.newSession())
    for key in ("spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    functions = own._jsparkSession.sessionState().functionRegistry()
    named = own._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for name in REMOVED:
        functions.dropFunction(named(name))
    dataset = own._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in views.items():
        dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    register_sql_functions(own)
    return own


def run_readonly_sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame] | None = None,
                     args: Mapping[str, object] | None = None) -> DataFrame:
    """K8: rows of a read-only query over ``views`` (default: the caller's
    temporary views); parameters by name (``:name``).  A query that names
    anything else raises, and nothing of it has run then."""
    if not text or not text.strip():
        raise ValueError("empty query")
    if views is None:
        views = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary}
    own = isolated(spark, views)
    wrapped = f"SELECT * FROM (\n{text.strip().rstrip(';')}\n) AS q"
    try:
        df = own.sql(wrapped, args=dict(args) if args else None)
    except Exception as e:  # unresolved names and refused syntax alike
        raise ReadOnlyError(f"refused: {str(e).splitlines()[0][:300]}") from e
    _check(df._jdf.queryExecution().analyzed(), {v.lower() for v in views})
    return df


def _check(plan, views: set[str]) -> None:
    """Refuses a resolved plan with a leaf or an expression that is not
    allowed.  What stands below a given view is the caller's own."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            name = node.desc().identifier()
            if not node.isTempView() or name.database().isDefined() or name.table().lower() not in views:
                raise ReadOnlyError(f"relation {name.unquotedString()} is not one of {sorted(views)}")
            continue
        below = _items(node.children()) + _items(node.innerChildren())
        if not below and kind not in FREE_LEAVES:
            raise ReadOnlyError(f"the query reads a {kind}, which is not one of {sorted(views)}")
        todo += [c for c in below if _is_plan(c)]
        for expression in _items(node.expressions()):
            todo += _subqueries(expression)


def _subqueries(expression) -> list:
    """Plans of the subqueries in an expression; refuses what is not Spark's own."""
    found, todo = [], [expression]
    while todo:
        e = todo.pop()
        full = e.getClass().getName()
        if not full.startswith(EXPRESSIONS) or e.getClass().getSimpleName() in REFUSED:
            raise ReadOnlyError(f"expression {e.getClass().getSimpleName()} is not allowed in read-only SQL")
        if full.startswith(EXPRESSIONS + "expressions.") and _has(e, "plan"):
            found.append(e.plan())
        todo += _items(e.children())
    return found


def _is_plan(node) -> bool:
    return _has(node, "childrenResolved") and _has(node, "maxRows")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


#: (class, method) -> whether the class has it, as found by reflection.
_METHODS: dict[tuple[str, str], bool] = {}


def _has(node, method: str) -> bool:
    key = node.getClass().getName(), method
    if key not in _METHODS:
        _METHODS[key] = any(m.getName() == method and not len(m.getParameterTypes()) for m in node.getClass().getMethods())
    return _METHODS[key]
