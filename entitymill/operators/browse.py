"""Lookups, search, sorting, pages and displays over runs and businesses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from entitymill import vocabulary as V
from entitymill.functions.text import blank_to_null
from entitymill.operators.validation import trail


# Rows up to the end of a page that one task may pick out; pages further on are located by counts.
DIRECT = 1 << 16

# Ranges a table is counted in per round, and keys per range that place their ends.
RANGES = 64
KEYS_PER_RANGE = 32


def window_of(rows: DataFrame, by: list[str], descending: bool, offset: int, size: int, direct: int = DIRECT) -> DataFrame:
    """``size`` rows from ``offset`` on in the order of ``by``; nulls count as smallest.

    Up to ``direct`` rows this is a top-k. Beyond, a bounded sample of keys (64 x
    32, by a hash) places the ends of ranges, one pass over the key columns counts
    each, and only the ranges that hold the page are looked at again, until the page
    lies within ``direct`` rows of a range's start. The sample decides how even the
    ranges are, never what is returned. Nothing is shuffled but counts, the last
    ends are pushed to the scan. ``by`` has to be unique for a defined order among
    ties; give a stored table, as it is read once or twice a round.
    """
    def key(values: list | None = None) -> Column:
        given = [F.col(c) for c in by] if values is None else [F.lit(v).cast(rows.schema[c].dataType) for c, v in zip(by, values)]
        return F.struct(*[g.alias(f"k{i}") for i, g in enumerate(given)])

    def before(end: list) -> Column:
        return key() > key(end) if descending else key() < key(end)

    def within(lo: list | None, hi: list | None) -> DataFrame:
        """Rows from ``lo`` to before ``hi``, with the same said of the first column alone for the scan."""
        first, out = F.col(by[0]), rows
        least, most = (hi, lo) if descending else (lo, hi)
        if least is not None and _comparable(least[0]):
            out = out.filter(first >= F.lit(least[0]))
        if most is not None and _comparable(most[0]):
            out = out.filter((first <= F.lit(most[0])) | first.isNull())
        out = out if lo is None else out.filter(~before(lo))
        return out if hi is None else out.filter(before(hi))

    def number(ends: list[list], a: int, b: int) -> Column:
        """Number of the range a row lies in, by halving."""
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(before(ends[m]), number(ends, a, m)).otherwise(number(ends, m + 1, b))

    order = [F.desc(c) if descending else F.asc(c) for c in by]
    lo = hi = None
    while offset > 0 and offset + size > direct:
        part = within(lo, hi).select(*by)
        sample = part.orderBy(F.xxhash64(*by)).limit(RANGES * KEYS_PER_RANGE).distinct().orderBy(*order).collect()
        step = max(1, len(sample) // RANGES)
        ends = [list(k) for k in sample[step::step]]
        counts = {r["n"]: r["count"] for r in part.groupBy(number(ends, 0, len(ends)).alias("n")).count().collect()}
        bounds, passed, start, stop = [lo, *ends, hi], 0, None, None
        for i in range(len(ends) + 1):
            here = counts.get(i, 0)
            if start is None and passed + here > offset:
                start, skipped = i, passed
            passed += here
            if stop is None and start is not None and passed >= offset + size:
                stop = i + 1
        if start is None:
            return rows.limit(0)
        narrowed = (bounds[start], bounds[stop] if stop is not None else hi)
        if narrowed == (lo, hi):
            break
        (lo, hi), offset = narrowed, offset - skipped
    return within(lo, hi).orderBy(*order).offset(offset).limit(size)


def _comparable(v: object) -> bool:
    return v is not None and v == v


def list_runs(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; a limit outside 1 to 100 or an offset below 0 is refused."""
    if not 1 <= limit <= 100:
        raise ValueError(f"limit {limit} is not between 1 and 100")
    if offset < 0:
        raise ValueError(f"offset {offset} is below 0")
    return window_of(runs, ["created_at", "run_id"], True, offset, limit)


def _newest(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id"))


def count_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("total"))


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows equal on every given key; an empty key finds nothing."""
    if any(v is None or v == "" for v in keys.values()):
        return df.filter(F.lit(False))
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def search_predicate(term: str | None) -> Column | None:
    """Prefix on name form, phone and city; anywhere in name, address, category.

    ``%`` and ``_`` in the term stay wildcards; letter case never matters.
    """
    text = (term or "").strip().lower()
    if not text:
        return None
    quoted = text.replace("\\", "\\\\")
    prefix, anywhere = quoted + "%", "%" + quoted + "%"
    wanted = {
        "normalized_name": prefix, "phone": prefix, "city": prefix,
        "name": anywhere, "address": anywhere, "category": anywhere,
    }
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).like(p) for c, p in wanted.items()])


def search(businesses: DataFrame, term: str | None) -> DataFrame:
    predicate = search_predicate(term)
    return businesses if predicate is None else businesses.filter(predicate)


def page(
    businesses: DataFrame, number: int = 1, size: int = 50, term: str | None = None,
    sort_by: str = "created_at", sort_order: str = "desc", run_id: str | None = None, direct: int = DIRECT,
) -> DataFrame:
    """One page, of one run if given: a top-k near the front, located by counts of ranges further on."""
    rows = businesses if run_id is None else businesses.filter(F.col("run_id") == run_id)
    column = sort_by if sort_by in V.SORT_COLUMNS else "created_at"
    return window_of(search(rows, term), [column, "id"], sort_order.lower() != "asc", max(0, (number - 1) * size), size, direct)


def page_meta(businesses: DataFrame, number: int = 1, size: int = 50, term: str | None = None) -> DataFrame:
    return search(businesses, term).agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(number).alias("page"), F.lit(size).alias("page_size"), "total",
        F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("bigint").alias("total_pages"),
    )


def detail(businesses: DataFrame, provenance: DataFrame, **keys: object) -> DataFrame:
    """Businesses with their provenance list, at most one entry per field each."""
    wanted = lookup(businesses, **keys) if keys else businesses
    trail = provenance.groupBy(F.col("business_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(
            "field_name", "field_value", "extraction_method", "confidence", "validator_rule"
        ))).alias("provenance")
    )
    return wanted.join(trail, "id", "left").withColumn(
        "provenance_count", F.coalesce(F.size("provenance"), F.lit(0))
    )


def details(businesses: DataFrame) -> DataFrame:
    """Every business with its provenance list, built in its own row: nothing is joined."""
    shown = ("field_name", "field_value", "extraction_method", "confidence", "validator_rule")
    entries = F.sort_array(F.transform(trail(), lambda e: F.struct(*[e[n].alias(n) for n in shown])))
    return businesses.withColumn("provenance", entries).withColumn("provenance_count", F.size("provenance"))


def count_by_run(businesses: DataFrame) -> DataFrame:
    return businesses.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def list_sources(sources: DataFrame, run_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return window_of(sources.filter(F.col("run_id") == run_id), ["seq"], False, offset, limit)


def known_ids(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct non-empty place ids and links per run: the seen-set of a resume."""
    places = sources.filter(F.col("external_id") != "").select("run_id", "external_id").distinct()
    links = sources.filter(F.col("source_url") != "").select("run_id", "source_url").distinct()
    return places, links


def dashboard(runs: DataFrame, latest: int = 50) -> DataFrame:
    """Totals of the ``latest`` runs, as many as asked for."""
    recent = _newest(runs).limit(latest)
    return recent.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status").isin("COMPLETED", "PARTIAL")).alias("completed_runs"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("total_saved"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("total_failed"),
    )


def latest_completed(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'COMPLETED'").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1)


def elapsed(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """Running time as text: completion (else ``now``) minus start."""
    end = F.coalesce(F.col("completed_at"), now if now is not None else F.current_timestamp())
    seconds = F.floor(F.timestamp_diff("MILLISECOND", F.col("started_at"), end) / 1000).cast("bigint")
    text = (
        F.when(F.col("started_at").isNull(), F.lit("Pending"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )
    return runs.withColumn("elapsed", text)


def display(businesses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """What the result table shows for missing values; columns in ``carry`` come along."""
    b = lambda c: blank_to_null(F.col(c))
    return businesses.select(
        *carry, "id", "name",
        F.coalesce(b("category"), F.lit("General")).alias("category"),
        F.coalesce(b("address"), F.lit("—")).alias("address"),
        F.coalesce(b("city"), F.lit("Unknown city")).alias("city"),
        F.coalesce(b("normalized_phone"), b("phone"), F.lit("Missing")).alias("phone"),
        F.when(b("website_domain").isNotNull(), F.coalesce(
            b("website"), F.concat(F.lit("https://"), F.col("website_domain"))
        )).alias("link"),
        F.coalesce(b("website_domain"), F.lit("Missing")).alias("website"),
    )
