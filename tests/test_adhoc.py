"""Read-only SQL guard (F6) and SQL functions (K8)."""

import pytest

from mnemospark.operators.adhoc import ReadOnlyError, run_readonly_sql
from mnemospark.sources.tables import messages
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def views(spark):
    return {"messages": messages(spark, SF_SMALL)}


def test_select_runs(spark, views):
    df = run_readonly_sql(spark, "select count(*) as n from messages where speaker = :s", views, {"s": "user_1"})
    assert df.first().n > 0


@pytest.mark.parametrize("text", [
    "DROP TABLE messages",
    "INSERT INTO messages SELECT * FROM messages",
    "select 1; drop table messages",
    "CREATE TABLE x AS SELECT 1",
    "select 1 from messages) q; drop view messages; select * from (select 1",
])
def test_writes_refused_before_running(spark, views, text):
    with pytest.raises(ReadOnlyError):
        run_readonly_sql(spark, text, views)
    assert views["messages"].count() > 0


@pytest.mark.parametrize("text", [
    "select * from text.`/etc/hostname`",
    "select java_method('java.lang.System', 'getProperty', 'user.dir') as x",
    "select reflect('java.lang.System', 'getProperty', 'user.dir') as x from messages",
    "select 1 as x where exists (select * from other_view)",
    "select (select max(try_reflect('java.lang.System', 'lineSeparator'))) as x",
    "with w as (select * from other_view) select * from w",
    "select * from identifier('other_view')",
    "with other_view as (select * from other_view) select * from other_view",
    "select * from (with other_view as (select 1 as x) select * from other_view) a, (select * from other_view) b",
    "select identifier('java_method')('java.lang.System', 'getProperty', 'user.dir') as x",
    "select * from identifier(java_method('java.lang.System', 'getProperty', 'user.dir'))",
    "select system.builtin.java_method('java.lang.System', 'getProperty', 'user.dir') as x",
    "select * from global_temp.shared_view",
    "select * from identifier('global_temp.shared_view')",
    "select (select count(*) from stored_table) as n",
    "select * from messages where exists (select 1 from default.stored_table)",
    "select input_file_name() as f from messages",
])
def test_outside_the_views_refused(spark, views, stored, text):
    with pytest.raises(ReadOnlyError):
        run_readonly_sql(spark, text, views)


@pytest.fixture(scope="module")
def stored(spark):
    spark.range(1).createOrReplaceTempView("other_view")
    spark.range(1).createOrReplaceGlobalTempView("shared_view")
    spark.range(3).write.mode("overwrite").saveAsTable("stored_table")
    yield
    spark.sql("DROP TABLE stored_table")


def test_the_callers_session_is_left_alone(spark, views):
    """Neither its views nor its settings nor its functions change."""
    spark.range(7).createOrReplaceTempView("messages")
    assert run_readonly_sql(spark, "select count(*) as n from messages", views).first().n != 7
    assert spark.table("messages").count() == 7
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
    assert spark.sql("select java_method('java.lang.Math', 'abs', -1) as x").first().x == "1"
    spark.catalog.dropTempView("messages")


def test_the_callers_temporary_views_are_the_default(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert run_readonly_sql(spark, "select count(*) as n from five").first().n == 5


def test_set_operations_windows_and_computed_names_run(spark, views):
    text = """select speaker, count(*) over (partition by speaker) as n from identifier('mess' || 'ages')
              union all select 'x', id from range(3) order by speaker limit 5"""
    assert run_readonly_sql(spark, text, views).count() == 5


def test_with_clause_and_subquery_run(spark, views):
    text = "with w as (select speaker from messages) select count(*) as n from w where speaker in (select speaker from messages)"
    assert run_readonly_sql(spark, text, views).first().n > 0


def test_trailing_comment_is_harmless(spark, views):
    assert run_readonly_sql(spark, "select 1 as x -- comment", views).first().x == 1


def test_distance_function_in_sql(spark, views):
    df = run_readonly_sql(spark, "select cosine_distance(embedding, embedding) as d from messages limit 1", views)
    assert abs(df.first().d) < 1e-9
