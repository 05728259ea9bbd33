"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame operations only.

Tokens in an encoding's alphabet are tested for what random characters show
and written language does not: letters evenly used (chi-squared), values above
and below the middle in as many runs as chance gives, and no correlation of
neighbours. Rejections are controlled by false discovery rate within encoding
and length band; tokens that stay and are long enough to have been rejected are
reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: Kind, pattern, group that is measured, its least length.
PATTERNS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Alphabets by name; a token's encoding is the first whose letters hold it. The order of letters gives their values.
ENCODINGS = {
    "base16": "0123456789abcdef",
    "BASE16": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Least length of a tested token, and where the length bands begin.
LEAST = 20
BANDS = (20, 24, 32, 48, 96, 256)
#: False discovery rate by band: short tokens carry less evidence, so rejecting them needs less.
RATES = (0.2, 0.2, 0.1, 0.05, 0.05, 0.05)
#: p-values are held to this many steps of a power of ten.
GRID, FLOOR = 20, 12
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once, however often ``then`` reads it."""
    return F.transform(F.array(value), then)[0]


def _blocks(items: Column) -> Column:
    """``items`` cut into about as many lists as each holds, so that work on a list and on the lists stays small."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    ends = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int"))
    return F.when(F.size(items) > 0, F.transform(ends, lambda k: F.slice(items, k * width + 1, width))).otherwise(F.slice(F.array(items), F.lit(1), F.lit(0)))


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, end, size, found): code points, end exclusive, the length of ``group``, the match.

    Positions are sums over the lengths before, first inside blocks of matches, then over the blocks.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    part = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    sizes = F.zip_with(whole, part, lambda m, p: F.struct(m.alias("found"), F.length(p).alias("part")))
    # one more gap than matches
    matches = F.filter(
        F.zip_with(sizes, F.split(text, pattern, -1), lambda m, gap: F.struct(F.length(gap).alias("gap"), m["found"].alias("found"), m["part"].alias("part"))),
        lambda m: m["found"].isNotNull(),
    )
    none = F.expr("cast(array() as array<struct<start: int, end: int, size: int, found: string>>)")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + F.length(m["found"])
        span = F.struct(start.alias("start"), end.alias("end"), m["part"].alias("size"), m["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["size"].alias("size"), s["found"].alias("found")))

    def placed(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        starts = F.aggregate(blocks, begin, lambda state, b: F.struct((state["at"] + b["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")), lambda state: state["starts"])
        return F.flatten(F.zip_with(blocks, starts, moved))

    inside = _let(matches, lambda m: F.transform(_blocks(m), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)))
    return F.when(F.rlike(text, F.lit(pattern)), _let(inside, placed)).otherwise(none)


def _free(tokens: Column, spans: Column) -> Column:
    """Those of ``tokens`` that none of ``spans`` overlaps; spans lie in blocks by start, most of which their bounds rule out."""
    def meet(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    bounded = F.transform(_blocks(spans), lambda b: F.struct(b[0]["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("spans")))
    return _let(bounded, lambda blocks: F.filter(tokens, lambda t: ~F.exists(blocks, lambda b: meet(b, t) & F.exists(b["spans"], lambda s: meet(s, t)))))


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns as (start, rank, kind, end), by start, then kind in the order listed."""
    def of(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        # runs of one class that are long enough are found at once; a failing match of `assign` may hide a later one and is dropped after
        quick = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}.get(kind, pattern)
        found = F.filter(find(text, quick, group), lambda s: s["size"] >= least)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[of(rank, *p) for rank, p in enumerate(PATTERNS)]))


def _encoding(token: Column) -> Column:
    body = F.regexp_replace(token, "=+$", "")
    out = F.lit(None).cast("string")
    for name, letters in reversed(ENCODINGS.items()):
        out = F.when(F.rlike(body, F.lit(f"^[{letters.replace('-', '')}{'-' if '-' in letters else ''}]+$")), F.lit(name)).otherwise(out)
    # a name in letters alone, or a number, is no encoding of random bytes
    return F.when(F.rlike(body, F.lit("[A-Za-z]")) & F.rlike(body, F.lit("[0-9]")), out)


def _tail(z: Column) -> Column:
    """Two-sided normal tail of ``z``, by a rational approximation (error below 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(10.0**-FLOOR), poly * F.exp(-x * x))


def battery(token: Column, encoding: Column) -> Column:
    """Smallest p-value of the tests, times their number: small if ``token`` is not random in its ``encoding``."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet = F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair])[encoding]
    values = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c).cast("double"))
    return F.when(encoding.isNotNull(), F.transform(F.array(F.struct(values.alias("v"), F.length(alphabet).cast("double").alias("k"))), lambda s: _tests(s["v"], s["k"]))[0])


def _tests(v: Column, k: Column) -> Column:
    n = F.size(v).cast("double")
    zero = F.lit(0.0)
    total = F.aggregate(v, zero, lambda a, x: a + x)
    squares = F.aggregate(v, zero, lambda a, x: a + x * x)
    # chi-squared over the alphabet, by its exact mean and variance under even use; letters too often used are the side that counts
    used = F.aggregate(F.array_distinct(v), zero, lambda a, x: a + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), 2.0))
    chi = used * k / n - n
    chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    # runs of values in the lower and the upper half of the alphabet
    high = F.aggregate(v, zero, lambda a, x: a + F.when(x > k / 2, 1.0).otherwise(0.0))
    next_ = F.slice(v, F.lit(2), F.size(v))
    runs = 1 + F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), next_, lambda x, y: ((x > k / 2) != (y > k / 2)).cast("double")), zero, lambda a, x: a + x)
    p = 2 * high * (n - high) / n
    runs_z = F.when((high == 0) | (high == n), F.lit(8.0)).otherwise((runs - p - 1) / F.sqrt(F.greatest(F.lit(0.25), p * (p - 1) / (n - 1))))
    # correlation of neighbours
    products = F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), next_, lambda x, y: x * y), zero, lambda a, x: a + x)
    mean, spread = total / n, squares / n - F.pow(total / n, F.lit(2.0))
    ends = mean * (v[0] + F.element_at(v, -1))
    serial = (products - 2 * mean * total + ends + (n - 1) * mean * mean) / F.greatest(F.lit(1e-9), n * spread)
    serial_z = F.when(spread < 1e-9, F.lit(8.0)).otherwise((serial + 1 / n) * F.sqrt(n))
    # even use can be too good as well (0123...), which runs and neighbours show
    return F.least(F.lit(1.0), 3 * F.least(_tail(F.greatest(F.lit(0.0), chi_z)), _tail(runs_z), _tail(serial_z)))


def _band(size: Column) -> Column:
    return sum((F.when(size >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))


def _cells(found: DataFrame) -> DataFrame:
    """(encoding, band, step, n): how many tokens of a stratum have which p-value, small p first."""
    return found.select(F.explode("_candidates").alias("c")).groupBy("c.encoding", "c.band", "c.step").agg(F.count("*").alias("n"))


def thresholds(found: DataFrame) -> dict[tuple[str, int], int]:
    """Per encoding and length band the last step of p at which randomness is rejected (Benjamini and Hochberg on the grid).

    There are at most len(ENCODINGS) * len(BANDS) strata, whatever the input.
    """
    cells = _cells(found)
    upto = Window.partitionBy("encoding", "band").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("encoding", "band")
    rate = F.element_at(F.array(*map(F.lit, RATES)), F.col("band") + 1)
    p = F.pow(F.lit(10.0), (F.col("step") + 1) / F.lit(float(GRID)) - FLOOR)
    passed = cells.withColumns({"below": F.sum("n").over(upto), "all": F.sum("n").over(whole)}).filter(p * F.col("all") <= rate * F.col("below"))
    return {(r["encoding"], r["band"]): r["step"] for r in passed.groupBy("encoding", "band").agg(F.max("step").alias("step")).collect()}


def scan(docs: DataFrame, key: list[Column], text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the columns ``key``, base and spans, both arrays of (start, rank, kind, end) by start, then rank.

    ``spans`` adds kind ``random`` where no base span overlaps: tokens of at least
    LEAST characters with letters and digits whose randomness is not rejected. A null text counts as
    empty. The texts are read once; only tokens and spans are kept, and of all
    tokens only counts per stratum and p-value meet.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = F.transform(find(body, CANDIDATE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("token")))
    base = base_spans(body)
    rows = docs.select(*key, base.alias("base"), tokens.alias("_tokens"))
    keys = rows.columns[:-2]
    free = _free(F.col("_tokens"), F.col("base"))
    named = F.filter(F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), _encoding(t["token"]).alias("encoding"))), lambda t: t["encoding"].isNotNull())

    def judged(t: Column) -> Column:
        step = F.floor((F.log10(battery(t["token"], t["encoding"])) + FLOOR) * GRID).cast("int")
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), _band(F.length(t["token"])).alias("band"), step.alias("step"))

    named_rows = cut_lineage(rows.select(*keys, "base", named.alias("_named")))
    found = cut_lineage(named_rows.select(*keys, "base", F.transform("_named", judged).alias("_candidates")))
    limits = thresholds(found)

    def limit(c: Column) -> Column:
        out = F.lit(-1)
        for (encoding, band), step in limits.items():
            out = F.when((c["encoding"] == encoding) & (c["band"] == band), F.lit(step)).otherwise(out)
        return out

    added = F.transform(
        F.filter("_candidates", lambda c: c["step"] > limit(c)),
        lambda c: F.struct(c["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")),
    )
    return found.select(*keys, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
