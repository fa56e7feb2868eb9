"""Path functions as native Spark expressions.

Four styles are understood: drive (``C:\\a``), UNC (``\\\\srv\\share\\a``), POSIX (``/a``) and URI
(``s3://bucket/a``). Each function takes the name of a column (or any SQL expression) holding a path.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A UNC root carries no trailing separator; the other roots keep theirs.
_BACKSLASH_ROOT = r"[A-Za-z]:[\\/]|\\\\[^\\/]+[\\/][^\\/]+"
_SLASH_ROOT = r"[A-Za-z][A-Za-z0-9+.\-]+:/(?:/[^/]*/?)?|/"
_ROOT = rf"^(?:{_BACKSLASH_ROOT}|{_SLASH_ROOT})"
_BACKSLASH_STYLE = r"^(?:[A-Za-z]:[\\/]|\\\\)"

# Groups 1+2 (or 3+4) are the root and what lies between it and the last segment. A root itself
# only matches the last alternative, which leaves every group empty.
_PARENT = (
    r"(?s)^(?:"
    rf"((?>{_BACKSLASH_ROOT}))(?:(.*[^\\/])?[\\/]+[^\\/]*|[^\\/]+)"
    rf"|((?>{_SLASH_ROOT}))(?:(.*[^/])?/+[^/]*|[^/]+)"
    r"|.*)$"
)
_ROOT_ONLY = r"^(?:[A-Za-z]:[\\/]*|[A-Za-z][A-Za-z0-9+.\-]+:/(?:/[^/]*/?)?|/+)$"


def _sql_literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def root_sql(path: str) -> str:
    return f"regexp_extract({path}, {_sql_literal(_ROOT)}, 0)"


def _parent_or_empty_sql(path: str) -> str:
    return f"regexp_replace({path}, {_sql_literal(_PARENT)}, '$1$2$3$4')"


def parent_path_sql(path: str) -> str:
    return f"nullif({_parent_or_empty_sql(path)}, '')"


def separator_sql(path: str) -> str:
    return rf"if({path} rlike {_sql_literal(_BACKSLASH_STYLE)}, '\\', '/')"


def prefixes_sql(folder: str) -> str:
    """The folders from the root down to and including ``folder``; empty for null.

    The one-element array binds root, body and separator, so they are evaluated once per row.
    """
    body = f"substr({folder}, length({root_sql(folder)}) + 1)"
    bound = (
        f"filter(array(named_struct('root', {root_sql(folder)}, 'body', {body}, "
        f"'separator', {separator_sql(folder)})), v -> v.body is not null)"
    )
    depth = "length(v.body) - length(replace(v.body, v.separator, '')) + 1"
    below = (
        f"filter(transform(sequence(1, {depth}), "
        "i -> concat(v.root, substring_index(v.body, v.separator, i))), "
        "p -> p <> v.root and not endswith(p, v.separator))"
    )
    return f"flatten(transform({bound}, v -> concat(array(v.root), {below})))"


def ancestors_sql(path: str) -> str:
    return prefixes_sql(parent_path_sql(path))


def leaf_name_sql(path: str) -> str:
    return (
        f"case when {path} rlike {_sql_literal(_ROOT_ONLY)} then {path} "
        f"when {path} rlike {_sql_literal(_BACKSLASH_STYLE)} "
        rf"then regexp_extract({path}, r'([^\\/]+)[\\/]*$', 1) "
        f"else regexp_extract({path}, '([^/]+)/*$', 1) end"
    )


def root_of(path: str) -> Column:
    """The root a path lives under; empty for a relative path."""
    return F.expr(root_sql(path))


def parent_path(path: str) -> Column:
    """The containing folder; null at a root and for null."""
    return F.expr(parent_path_sql(path))


def ancestors(path: str) -> Column:
    """Every strict ancestor of a path, root first."""
    return F.expr(ancestors_sql(path))


def ancestors_or_self(folder: str) -> Column:
    """The folder's ancestors followed by the folder itself."""
    return F.expr(prefixes_sql(folder))


def folder_of(path: str) -> Column:
    """``parent_path`` with an empty string for null.

    A key that cannot be null spares joins a null test, which would be pushed down to the scan and
    evaluate the expression a second time.
    """
    return F.coalesce(F.expr(_parent_or_empty_sql(path)), F.lit(""))


def with_ancestors(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """Each row once per folder from the root down to and including ``folder``, as column ``name``.

    The same as exploding ``ancestors_or_self``, but the prefixes are cut after the explode, where
    they are part of generated code. A folder without a root yields nothing; it is dropped after the
    explode, because a test before it would be pushed down to the rows that ``folder`` is made from.
    """
    steps = "length(_body) - length(replace(_body, _separator, '')) + 1"
    depths = f"sequence(0, if(_body = '', 0, {steps}))"
    # Repeated separators do not begin another folder.
    distinct = (
        f"filter({depths}, d -> d = 0 or not endswith(substring_index(_body, _separator, d), _separator))"
    )
    return (
        rows.withColumn("_root", root_of(folder))
        .withColumn("_separator", F.expr(separator_sql(folder)))
        .withColumn("_base", F.expr("if(endswith(_root, _separator), _root, concat(_root, _separator))"))
        .withColumn("_body", F.expr(f"substr({folder}, length(_base) + 1)"))
        .withColumn(
            "_depths",
            F.expr(
                f"case when _root = '' then null when contains(_body, concat(_separator, _separator)) "
                f"then {distinct} else {depths} end"
            ),
        )
        .select("*", F.explode_outer("_depths").alias("_depth"))
        .filter("_depth is not null")
        .withColumn(
            name,
            F.expr(
                "coalesce(if(_depth = 0, _root, "
                "concat(_base, substring_index(_body, _separator, _depth))), '')"
            ),
        )
        .drop("_root", "_separator", "_base", "_body", "_depths", "_depth")
    )


def leaf_name(path: str) -> Column:
    """The last segment; a drive, POSIX or URI root is its own name."""
    return F.expr(leaf_name_sql(path))


def normalize_drive(raw: str) -> Column:
    """Canonical root form: ``c``, ``C:`` and ``C:\\`` become ``C:\\``; other roots end in a separator."""
    text = f"trim({raw})"
    bare = rf"rtrim('\\/', {text})"
    return F.expr(
        rf"case when {bare} rlike r'^\p{{L}}:?$' then concat(upper(left({bare}, 1)), ':\\') "
        rf"when {raw} rlike r'^(?:/|[A-Za-z][A-Za-z0-9+.\-]+:/)' "
        f"then if(endswith({raw}, '/'), {raw}, concat({raw}, '/')) "
        rf"when endswith({raw}, '\\') then {raw} else concat({raw}, '\\') end"
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``parent_path(p)`` callable from SQL text; Catalyst inlines its body."""
    spark.sql(
        "create or replace temporary function parent_path(p string) returns string "
        f"deterministic return {parent_path_sql('p')}"
    )
