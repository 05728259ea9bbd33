"""Web addresses, host names, e-mail addresses and profile links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import blank_to_null, is_blank, strip


def _decoded(c: Column) -> Column:
    spaced = F.replace(c, F.lit("+"), F.lit(" "))
    return F.url_decode(F.regexp_replace(spaced, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    # form encoding leaves * alone and escapes ~; the canonical form does the reverse
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    def rebuilt(pair: Column) -> Column:
        key = _decoded(F.substring_index(pair, "=", 1))
        value = _decoded(F.regexp_replace(pair, r"(?s)^[^=]*=", ""))
        kept = pair.rlike(r"(?s)^[^=]*=.") & ~F.lower(key).rlike(V.TRACKING_PARAMETER)
        return F.when(kept, F.concat(_encoded(key), F.lit("="), _encoded(value)))

    return F.when(query == "", F.lit("")).otherwise(
        F.array_join(F.transform(F.split(query, "&"), rebuilt), "&")
    )


def website_host(c: Column) -> Column:
    """Lower-cased authority of an http(s) address, scheme optional."""
    return F.lower(F.regexp_extract(strip(c), r"(?is)^(?:https?://)?([^/?#]*)", 1))


def domain(c: Column) -> Column:
    """Host without ``www.`` and port, NULL when it has no letter ending."""
    host = F.substring_index(F.regexp_replace(website_host(c), r"^www\.", ""), ":", 1)
    return F.when(host.rlike(V.DOMAIN_ENDING), host)


def with_url(df: DataFrame, column: str) -> DataFrame:
    """Add website_url (canonical), website_domain and website_status.

    Steps get their own projection so that none is evaluated twice.
    """
    c = F.col
    df = df.withColumn("_raw", F.regexp_replace(strip(c(column)), r"[\t\r\n]", ""))
    df = df.withColumns({
        "_scheme": F.coalesce(blank_to_null(F.lower(F.regexp_extract(c("_raw"), r"(?i)^(https?)://", 1))), F.lit("https")),
        "_host": website_host(c("_raw")),
        "_rest": F.regexp_replace(c("_raw"), r"(?is)^(?:https?://)?[^/?#]*", ""),
    })
    path = F.regexp_replace(F.regexp_extract(c("_rest"), r"(?s)^([^?#]*)", 1), r"(?s);[^/]*$", "")
    df = df.withColumns({
        "_path": F.regexp_replace(path, r"/+$", ""),
        "_query": F.regexp_extract(c("_rest"), r"(?s)^[^?#]*\?([^#]*)", 1),
        "website_domain": domain(c("_raw")),
    })
    df = df.withColumn("_query", _clean_query(c("_query")))
    url = F.concat(
        c("_scheme"), F.lit("://"), c("_host"), c("_path"),
        F.when(c("_query") != "", F.concat(F.lit("?"), c("_query"))).otherwise(F.lit("")),
        F.when((c("_path") == "") & ~c("_query").endswith("/"), F.lit("/")).otherwise(F.lit("")),
    )
    return df.withColumns({
        "website_url": F.when(c("website_domain").isNotNull(), url),
        "website_status": F.when(is_blank(c(column)), F.lit("MISSING"))
        .when(c("website_domain").isNotNull(), F.lit("FOUND")).otherwise(F.lit("INVALID")),
    }).drop("_raw", "_scheme", "_host", "_rest", "_path", "_query")


def normalize_email(c: Column) -> Column:
    """struct(email, normalized_email, is_verified_format)."""
    clean = F.lower(strip(F.regexp_replace(strip(c), r"(?i)^mailto:", "")))
    clean = F.regexp_extract(clean, r"(?s)^([^?]*)", 1)
    return F.struct(
        c.alias("email"),
        blank_to_null(clean).alias("normalized_email"),
        F.coalesce(clean.rlike(rf"^(?:{V.TEXT_EMAIL})$"), F.lit(False)).alias("is_verified_format"),
    )


def social_network(link: Column) -> Column:
    """Name of the network a link leads to, NULL for any other host."""
    host = domain(link)

    def of(names: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [(host == n) | host.endswith("." + n) for n in names])

    return F.coalesce(*[F.when(of(hosts), F.lit(net)) for net, hosts in V.SOCIAL_HOSTS.items()])


def profile_url(link: Column) -> Column:
    """Canonical profile link: https, no query, no trailing slash."""
    path = F.regexp_replace(
        F.regexp_extract(strip(link), r"(?is)^(?:https?://)?[^/?#]*([^?#]*)", 1), r"/+$", ""
    )
    return F.when(domain(link).isNotNull() & (path != ""), F.concat(F.lit("https://"), domain(link), path))


def profile_name(link: Column) -> Column:
    return blank_to_null(F.regexp_extract(profile_url(link), r"([^/]+)$", 1))
