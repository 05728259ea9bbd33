"""Phone numbers under the Indian numbering plan.

A number counts as found when it is possible, not only when it is assigned.
Numbers carrying a foreign country code are kept when the code is in use and
their length fits the international plan, because no world-wide metadata is
consulted. A number whose code is not in use cannot be read as international;
its digits alone are then tried as an Indian mobile number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import is_blank, strip


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _is_national(c: Column) -> Column:
    return c.rlike(V.PHONE_NATIONAL)


def _rest(c: Column, start: int) -> Column:
    return F.substr(c, F.lit(start))


def with_phone(df: DataFrame, column: str, e164: str = "normalized_phone", status: str = "phone_status") -> DataFrame:
    """Add the international form and FOUND, MISSING or INVALID.

    Each step is its own projection: a step's result is read several times by
    the next one, and nesting the expressions would repeat the work each time.
    """
    c = F.col
    bare = strip(F.regexp_replace(strip(c(column)), V.PHONE_LABEL, ""))
    df = df.withColumn("_body", F.regexp_replace(
        F.regexp_extract(bare, r"(?s)([+0-9].*)$", 1),
        r"(?i)[\s;,]*(?:extn?\.?|ext\.|x|#)[\s.:]*[0-9]{1,7}$", "",
    ))
    lettered = F.length(F.regexp_replace(c("_body"), r"[^A-Za-z]", "")) >= 3
    df = df.withColumn("_dialled", F.when(
        lettered, F.translate(F.upper(c("_body")), V.KEYPAD_LETTERS, V.KEYPAD_DIGITS)
    ).otherwise(c("_body")))
    df = df.withColumns({
        "_digits": _digits(c("_dialled")),
        "_readable": F.length(_digits(c("_body"))) >= 3,
    })
    df = df.withColumn("_abroad", F.when(c("_digits").startswith("00"), _rest(c("_digits"), 3)).when(
        c("_dialled").startswith("+"), c("_digits")
    ))
    alone = _digits(bare)
    df = df.withColumn("_alone", F.when(~c("_abroad").rlike(V.PHONE_COUNTRY), F.when(alone.rlike("^[6-9][0-9]{9}$"), F.concat(F.lit("+91"), alone)).when(
        alone.rlike("^91[6-9][0-9]{9}$"), F.concat(F.lit("+"), alone)
    ).when(alone.rlike("^0[6-9][0-9]{9}$"), F.concat(F.lit("+91"), _rest(alone, 2))).otherwise(F.lit(""))))
    carries_code = c("_digits").startswith("91") & (
        (~_is_national(c("_digits")) & _is_national(_rest(c("_digits"), 3)))
        | (F.length("_digits") > V.PHONE_MAX_DIGITS)
    )
    df = df.withColumn("_line", F.when(c("_abroad").isNotNull(), _rest(c("_abroad"), 3)).when(
        carries_code, _rest(c("_digits"), 3)
    ).otherwise(c("_digits")))
    keeps_zero = _is_national(c("_line")) & ~_is_national(_rest(c("_line"), 2))
    df = df.withColumn("_national", F.when(
        c("_line").startswith("0") & ~keeps_zero, _rest(c("_line"), 2)
    ).otherwise(c("_line")))
    indian = F.coalesce(c("_abroad").startswith("91"), F.lit(True))
    possible = F.length("_national").between(V.PHONE_MIN_DIGITS, V.PHONE_MAX_DIGITS)
    df = df.withColumn(e164, F.when(
        ~is_blank(c(column)) & c("_readable"),
        F.when(c("_alone").isNotNull(), F.nullif(c("_alone"), F.lit(""))).when(indian & possible, F.concat(F.lit("+91"), c("_national"))).when(
            ~indian & c("_abroad").rlike(r"^[1-9][0-9]{6,14}$"), F.concat(F.lit("+"), c("_abroad"))
        ),
    ))
    return df.withColumn(
        status,
        F.when(is_blank(c(column)), F.lit("MISSING")).when(c(e164).isNotNull(), F.lit("FOUND")).otherwise(F.lit("INVALID")),
    ).drop("_body", "_dialled", "_digits", "_readable", "_abroad", "_alone", "_line", "_national")
