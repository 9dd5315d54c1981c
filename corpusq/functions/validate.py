"""Row checks. Each gives an error code column (NULL = fine) instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.config import EngineConfig
from corpusq.functions.text import file_suffix


def _code(bad: Column, code: int) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(code))


def suffix_error(name: Column) -> Column:
    return _code(~file_suffix(name).isin(fv.SUPPORTED_SUFFIXES), fv.UNSUPPORTED_TYPE)


def size_error(n_bytes: Column, max_bytes: int) -> Column:
    """Exactly the limit still passes."""
    return _code(n_bytes > max_bytes, fv.TOO_LARGE)


def question_error(question: Column) -> Column:
    return _code(~F.length(question).between(1, fv.MAX_QUESTION_CHARS), fv.INVALID)


def top_k_or_default(top_k: Column, default: int = fv.DEFAULT_TOP_K) -> Column:
    return F.coalesce(top_k, F.lit(default))


def top_k_error(top_k: Column, most: int = fv.MAX_TOP_K,
                default: int = fv.DEFAULT_TOP_K) -> Column:
    return _code(~top_k_or_default(top_k, default).between(1, most), fv.INVALID)


def user_id_error(user_id: Column) -> Column:
    return _code(~(user_id.rlike(fv.USER_ID_PATTERN)
                   & F.length(user_id).between(1, fv.MAX_USER_ID_CHARS)), fv.INVALID)


def user_error(user_id: Column, display_name: Column) -> Column:
    good = (user_id.rlike(fv.USER_ID_PATTERN)
            & F.length(user_id).between(1, fv.MAX_USER_ID_CHARS)
            & F.length(display_name).between(1, fv.MAX_DISPLAY_NAME_CHARS))
    return _code(~good, fv.INVALID)


def collections_error(names: Column) -> Column:
    return _code(~(F.size(names) >= 1), fv.INVALID)


def map_role(role: Column) -> Column:
    """Common role names onto the two stored ones; others stay and are rejected."""
    return (F.when(role == "user", F.lit("human"))
            .when(role == "assistant", F.lit("ai")).otherwise(role))


def role_error(role: Column) -> Column:
    return _code(~role.isin(fv.ROLES), fv.INVALID)


def length_error(df: DataFrame, table: str) -> Column:
    """422 when any capped column of `table` present in `df` is too long."""
    caps = {c: n for c, n in fv.COLUMN_CAPS[table].items() if c in df.columns}
    bad = F.lit(False)
    for name, cap in caps.items():
        bad = bad | (F.coalesce(F.length(name), F.lit(0)) > cap)
    return _code(bad, fv.INVALID)


def check_queries(queries: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Queries + effective top_k + error_code (limits of question, top_k and user id).

    A question without a user id is the default user's; one with an id no user can have is
    refused.
    """
    user = (F.when(F.coalesce(F.col("user_id"), F.lit("")) != "", user_id_error(F.col("user_id")))
            if "user_id" in queries.columns else F.lit(None).cast("int"))
    return queries.withColumns({
        "error_code": F.coalesce(
            question_error(F.col("question")),
            top_k_error(F.col("top_k"), config.max_top_k, config.default_top_k), user),
        "top_k": top_k_or_default(F.col("top_k"), config.default_top_k),
    })


def check_uploads(uploads: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Uploads (filename, n_bytes) + error_code."""
    return uploads.withColumn("error_code", F.coalesce(
        suffix_error(F.col("filename")),
        size_error(F.col("n_bytes"), config.max_upload_bytes)))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("error_code").isNull()).drop("error_code")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("error_code").isNotNull())
