"""Matching two sources: blocking, scores, decisions, unmatched reports.

Pairs are only formed where they can matter. A decision at threshold T with
margin m depends on pairs scoring at least T - m, the floor. From the weights
follow the smallest sets of signals that a pair at the floor has to agree in;
each set is a block, so no pair at or above the floor is missed. A floor that
the name alone can reach has no blocks and is refused; the best candidate below
any floor is found by ``ranking``. Reports also hold the pairs of the report
blocks, whatever they score.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from entitymill import vocabulary as V
from entitymill.functions.geo import distance_km
from entitymill.functions.similarity import address_tokens, equal_score, jaccard, name_score, tokens
from entitymill.functions.text import literal_map
from entitymill.operators.scale import HOT_ROWS, MAX_HOT_KEYS, attach_per_key
from entitymill.session import cut_lineage

COMPARED = [
    "run_id", "normalized_name", "normalized_phone", "website_domain", "address", "city", "category", "social",
]
SYNONYM_SCORE = 0.8


#: Signals compared for equality. A name is a little like any other; an address agrees by its words.
EQUAL = ("phone", "domain", "city", "category", "social")


def agreements(weights: dict[str, float], floor: float) -> list[tuple[tuple[str, ...], float | None]]:
    """The smallest sets of signals one of which every pair at the floor agrees in.

    Each is (equal signals, least address score); None: the address is not needed.
    """
    total = lambda signals: weights["name"] + sum(weights[s] for s in signals)
    sets = [frozenset(c) for n in range(len(EQUAL) + 1) for c in combinations(EQUAL, n)]
    enough = [s for s in sets if total(s) >= floor]
    with_address = [s for s in sets if total(s) < floor <= total(s) + weights["address"]]
    if frozenset() in enough:
        raise ValueError(f"a floor of {floor:g} can be reached by the name alone; no block finds all its pairs")
    smallest = lambda family: [s for s in family if not any(o < s for o in family)]
    out = [(tuple(k for k in EQUAL if k in s), None) for s in smallest(enough)]
    for s in smallest(with_address):
        most = max(total(o) for o in with_address if o >= s)
        out.append((tuple(k for k in EQUAL if k in s), max((floor - most) / weights["address"], 1e-9)))
    return out


def profiles(df: DataFrame) -> DataFrame:
    """One row per distinct set of compared values: copies are compared once."""
    known = df.select("id", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COMPARED])
    grouped = known.groupBy(*COMPARED).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return grouped.withColumns({
        "pid": F.sha2(F.to_json(F.struct(*COMPARED), {"ignoreNullFields": "false"}), 256),
        "name_tokens": F.coalesce(tokens(F.col("normalized_name")), F.array().cast("array<string>")),
        "address_tokens": F.coalesce(address_tokens(F.col("address")), F.array().cast("array<string>")),
    })


def rare_first(sides: list[DataFrame]) -> list[DataFrame]:
    """``sides`` with their address words ordered from rare to common, as counted over both."""
    words = [df.select("pid", F.explode("address_tokens").alias("w")) for df in sides]
    counts = words[0].unionByName(words[1]).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    out = []
    for df, own in zip(sides, words):
        ordered = own.join(counts, "w").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("c", "w"))).alias("_words"))
        known = df.join(ordered, "pid", "left")
        out.append(known.withColumn("address_tokens", F.coalesce(F.col("_words.w"), F.col("address_tokens"))).drop("_words"))
    return out


def _leading(words: Column, least: float) -> Column:
    """Words, in a fixed order, that two sets with Jaccard >= ``least`` cannot all differ in."""
    n = F.size(words)
    return F.slice(words, F.lit(1), F.greatest(n - F.ceil(n * least).cast("int") + 1, F.lit(0)))


def _meaning(category: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(V.CATEGORY_SYNONYMS), F.lower(category)), F.lower(category))


def _key(kind: str, *parts: Column) -> Column:
    """Null if a part is."""
    return F.concat(F.lit(kind), *[x for c in (F.col("run_id"), *parts) for x in (F.lit("\x1f"), c)])


def _with_word(kind: str, fixed: list[Column]):
    return lambda w: _key(kind + "+address", *fixed, w)


def report_keys() -> Column:
    """Where pairs are reported whatever they score: end of the phone, domain, category in a city, name's beginning in a city."""
    c = F.col
    return F.array(
        _key("r:phone", F.substring("normalized_phone", -7, 7)), _key("r:domain", c("website_domain")),
        _key("r:category", c("city"), _meaning(c("category"))), _key("r:name", c("city"), F.substring("normalized_name", 1, 4)),
    )


def block_keys(weights: dict[str, float], floor: float, reports: bool = False) -> Column:
    """The blocks a profile is in; with ``reports`` also those of report_keys."""
    value = {
        "phone": F.col("normalized_phone"), "domain": F.col("website_domain"), "city": F.col("city"),
        "category": _meaning(F.col("category")), "social": F.col("social"),
    }
    none = F.array().cast("array<string>")
    keys = []
    for signals, least in agreements(weights, floor):
        fixed, kind = [value[s] for s in signals], "+".join(signals)
        if least is None:
            keys.append(F.array(_key(kind, *fixed)))
        else:
            keys.append(F.coalesce(F.transform(
                _leading(F.col("address_tokens"), least), _with_word(kind, fixed)), none))
    return F.array_compact(F.concat(*keys, *([report_keys()] if reports else [])))


def dealt_blocks(left: DataFrame, right: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Spread the rows of a hot block over parts, by the counts of both sides.

    A part meets every part of the other side. Keys that reach the threshold
    number at most rows / threshold, so the lookup is broadcast with a proven bound.
    """
    sizes = left.select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("key", F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.sum(F.col("l") + F.col("r"))).first()[0] or 0
    threshold = max(hot_rows, total // MAX_HOT_KEYS + 1)
    hot = F.broadcast(sizes.filter((F.col("l") >= threshold) | (F.col("r") >= threshold)).select(
        "key", F.ceil(F.col("l") / threshold).cast("int").alias("lp"), F.ceil(F.col("r") / threshold).cast("int").alias("rp")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine, theirs = (F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1))) for c in (own, other))
        met = df.join(hot, "key", "left").withColumn("_theirs", theirs).withColumn(own, F.pmod(F.xxhash64("pid"), mine).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_theirs") - 1))).drop("_theirs")

    return dealt(left, "lp", "rp"), dealt(right, "rp", "lp")


def side_columns(df: DataFrame, side: str, plain: list[str]) -> DataFrame:
    """``df`` with its columns as l_* or r_*, but for ``plain``."""
    return df.select(*plain, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in plain])


def candidates(
    left: DataFrame, right: DataFrame, floor: float, weights: dict[str, float] | None = None, hot_rows: int = HOT_ROWS, reports: bool = False,
) -> DataFrame:
    """Profile pairs that share a block, each once, as l_* and r_* columns."""
    keys = block_keys(weights or V.MATCH_WEIGHTS, floor, reports)
    # each read by the counts and by the pairs
    blocked = [cut_lineage(df.withColumn("keys", keys)) for df in rare_first([profiles(left), profiles(right)])]
    a, b = dealt_blocks(*[df.withColumn("key", F.explode("keys")) for df in blocked], hot_rows)
    dealt = ["key", "lp", "rp"]
    met = side_columns(a, "l", dealt).join(side_columns(b, "r", dealt), dealt)
    # a pair meets once per shared block; it is kept at the first, without a distinct
    first = F.try_element_at(F.array_intersect("l_keys", "r_keys"), F.lit(1))
    return met.filter(F.col("key") == first).drop(*dealt)


def category_relation(a: Column, b: Column, a_parent: Column | None = None, b_parent: Column | None = None) -> Column:
    """EXACT, SYNONYM, PARENT_CHILD_COMPATIBLE, RELATED, CONFLICTING or UNKNOWN; the parents as with_parents attaches them."""
    meaning = literal_map(V.CATEGORY_SYNONYMS)
    ca, cb = F.try_element_at(meaning, F.lower(a)), F.try_element_at(meaning, F.lower(b))
    pa, pb = (F.lower(p) if p is not None else F.lit(None).cast("string") for p in (a_parent, b_parent))
    return (
        F.when(F.lower(a) == F.lower(b), F.lit("EXACT"))
        .when(ca == cb, F.lit("SYNONYM"))
        .when((pa == F.lower(b)) | (pb == F.lower(a)), F.lit("PARENT_CHILD_COMPATIBLE"))
        .when(pa == pb, F.lit("RELATED"))
        .when(ca.isNotNull() & cb.isNotNull(), F.lit("CONFLICTING"))
        .otherwise(F.lit("UNKNOWN"))
    )


def with_parents(pairs: DataFrame, tree: DataFrame, columns: tuple[str, ...] = ("l_category", "r_category")) -> DataFrame:
    """``pairs`` with the parent of each of ``columns`` in ``tree`` (category, parent), as <column>_parent."""
    for c in columns:
        up = tree.select(F.lower("category").alias("_c"), F.col("parent").alias(f"{c}_parent"))
        pairs = pairs.join(up, F.lower(c) == F.col("_c"), "left").drop("_c")
    return pairs


def signal_scores(pairs: DataFrame) -> DataFrame:
    """Seven scores between 0 and 1; a value missing on either side scores 0."""
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    relation = category_relation(l("category"), r("category"))
    eq = lambda c: equal_score(l(c), r(c))
    return pairs.withColumns({
        "phone_score": eq("normalized_phone"),
        "domain_score": eq("website_domain"),
        "name_score": name_score(l("normalized_name"), r("normalized_name"), l("name_tokens"), r("name_tokens")),
        "address_score": jaccard(l("address_tokens"), r("address_tokens")),
        "city_score": eq("city"),
        "category_score": F.when(relation == "EXACT", F.lit(1.0)).when(relation == "SYNONYM", F.lit(SYNONYM_SCORE)).otherwise(F.lit(0.0)),
        "social_score": eq("social"),
    })


def weighted_score(weights: dict[str, float] | None = None) -> Column:
    total = F.lit(0.0)
    for signal, weight in (weights or V.MATCH_WEIGHTS).items():
        total = total + F.col(f"{signal}_score") * F.lit(float(weight))
    return F.round(total, 6)


def strong_identity() -> dict[str, Column]:
    """Flags only: the size of a boost is not defined anywhere."""
    return {
        "strong_phone": (F.col("phone_score") == 1.0) & (F.col("city_score") == 1.0),
        "strong_domain": (F.col("domain_score") == 1.0) & (F.col("name_score") >= 0.80),
    }


def score_pairs(
    left: DataFrame, right: DataFrame, floor: float = V.MATCH_THRESHOLD - V.AMBIGUITY_MARGIN, weights: dict[str, float] | None = None,
    hot_rows: int = HOT_ROWS, reports: bool = False,
) -> DataFrame:
    """Every profile pair scoring at least ``floor``, scored where it is formed; with ``reports`` those in the report blocks too.

    Decisions need a floor of their threshold less their margin or lower; it
    travels as metadata of the score.
    """
    scored = signal_scores(candidates(left, right, floor, weights, hot_rows, reports)).withColumn("score", weighted_score(weights))
    kept = F.col("score") >= floor
    if reports:
        kept = kept | F.exists(F.array_intersect("l_keys", "r_keys"), lambda k: k.startswith("r:"))
    scored = scored.filter(kept)
    known = scored.withMetadata("score", {"floor": float(floor)}).drop("l_keys", "r_keys")
    return known.withColumns(strong_identity())


def profile_ids(rows: DataFrame) -> DataFrame:
    """(id, run_id, pid) of every record."""
    known = rows.select("id", *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COMPARED])
    return known.select("id", "run_id", F.sha2(F.to_json(F.struct(*COMPARED), {"ignoreNullFields": "false"}), 256).alias("pid"))


def record_pairs(scored: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of profiles as pairs of records, l_id and r_id: copies are scored once and all reported."""
    a = profile_ids(left).select(F.col("pid").alias("l_pid"), F.col("id").alias("l_id"))
    b = profile_ids(right).select(F.col("pid").alias("r_pid"), F.col("id").alias("r_id"))
    return scored.join(a, "l_pid").join(b, "r_pid")


def _best_two(scored: DataFrame, side: str, other: str) -> DataFrame:
    """Best candidate and runner-up score per profile of one side.

    Equal copies of the best candidate tie with it.
    """
    w = Window.partitionBy(f"{side}_pid").orderBy(F.desc("score"), f"{other}_first_id")
    top = scored.select(f"{side}_pid", f"{side}_copies", "score", f"{other}_first_id", f"{other}_copies").withColumn(
        "rn", F.row_number().over(w)
    ).filter("rn <= 2")
    return top.groupBy(f"{side}_pid").agg(
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("best_score"),
        F.max(F.when(F.col("rn") == 1, F.col(f"{other}_first_id"))).alias("best_id"),
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("_next"),
        F.max(F.when(F.col("rn") == 1, F.col(f"{other}_copies"))).alias("_copies"),
        F.max(f"{side}_copies").alias("n"),
    ).withColumn(
        "second_score", F.when(F.col("_copies") > 1, F.col("best_score")).otherwise(F.coalesce("_next", F.lit(0.0)))
    ).drop("_next", "_copies")


def decide(threshold: Column, margin: float = V.AMBIGUITY_MARGIN) -> Column:
    return (
        F.when(F.col("best_score").isNull() | (F.col("best_score") < threshold), F.lit("UNMATCHED"))
        .when(F.col("best_score") - F.col("second_score") >= margin, F.lit("MATCHED"))
        .otherwise(F.lit("AMBIGUOUS"))
    )


def _reason() -> Column:
    return (
        F.when(F.col("decision") == "MATCHED", F.lit(None).cast("string"))
        .when(F.col("decision") == "AMBIGUOUS", F.lit("AMBIGUOUS_CANDIDATES"))
        .when(F.col("best_score").isNull(), F.lit("NO_CANDIDATE")).otherwise(F.lit("BELOW_THRESHOLD"))
    )


def _refuse_below(floor: float | None, threshold: float, margin: float) -> None:
    if floor is not None and threshold - margin < floor:
        raise ValueError(f"pairs were scored down to {floor:g}; threshold {threshold:g} with margin {margin:g} needs {threshold - margin:g}")


def decisions(
    side_rows: DataFrame, scored: DataFrame, side: str = "l", threshold: float = V.MATCH_THRESHOLD,
    margin: float = V.AMBIGUITY_MARGIN, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per record of one side: best candidate, scores, decision, reason.

    Refused if ``scored`` does not reach down to the threshold less the margin.
    """
    floor = scored.schema["score"].metadata.get("floor")
    _refuse_below(floor, threshold, margin)
    other = "r" if side == "l" else "l"
    best = _best_two(scored, side, other).withColumnRenamed(f"{side}_pid", "pid")
    # copies share one profile, possibly very many of them
    met = attach_per_key(profile_ids(side_rows), best, "pid", "n", side_rows.count(), hot_rows, "left")
    out = met.drop("pid").withColumn("threshold", F.lit(float(threshold)))
    if floor is not None:
        out = out.withMetadata("best_score", {"floor": floor})
    return out.withColumn("decision", decide(F.col("threshold"), margin)).withColumn("reason", _reason())


def with_best_candidates(decided: DataFrame, best: DataFrame) -> DataFrame:
    """Records that were not matched, with the best candidate of all they could be compared with (``ranking.best_candidates``)."""
    rest = decided.filter("decision <> 'MATCHED'").drop("best_id", "best_score", "reason")
    return rest.join(best.drop("run_id"), "id", "left").withColumn("reason", _reason())


def resolve_conflicts(decided: DataFrame) -> DataFrame:
    """A listing is matched once: its best claimant keeps it, the others conflict."""
    matched = decided.filter("decision = 'MATCHED'")
    winners = matched.groupBy("run_id", "best_id").agg(
        F.min(F.struct((-F.col("best_score")).alias("s"), F.col("id").alias("id"))).getField("id").alias("id")
    ).withColumn("_wins", F.lit(True))
    return decided.join(winners, ["run_id", "best_id", "id"], "left").withColumn(
        "decision",
        F.when((F.col("decision") == "MATCHED") & F.col("_wins").isNull(), F.lit("CONFLICT")).otherwise(F.col("decision")),
    ).drop("_wins")


def _explained(signal: str, weight: float) -> Column:
    """Line of one signal. Equal, synonymous and different values have fixed lines, which Spark formats once and not per pair."""
    line = lambda score: F.format_string(f"{signal}: %.2f%% x {weight:g} = %.2f", score * 100, score * float(weight))
    score = F.col(f"{signal}_score")
    fixed = F.when(score == 0.0, line(F.lit(0.0))).when(score == 1.0, line(F.lit(1.0)))
    if signal == "category":
        fixed = fixed.when(score == SYNONYM_SCORE, line(F.lit(SYNONYM_SCORE)))
    return fixed.otherwise(line(score))


def explain(weights: dict[str, float] | None = None) -> Column:
    """Component x weight lines and the total."""
    lines = [_explained(s, w) for s, w in (weights or V.MATCH_WEIGHTS).items()]
    return F.concat_ws("; ", *lines, F.format_string("total = %.2f%%", F.col("score")))


def rematch(decided: DataFrame, threshold: float, evaluation: str, margin: float = V.AMBIGUITY_MARGIN) -> DataFrame:
    """A new evaluation of stored scores; the earlier one stays as it is. Refused below what was scored."""
    _refuse_below(decided.schema["best_score"].metadata.get("floor"), threshold, margin)
    again = decided.withColumn("threshold", F.lit(float(threshold)))
    return again.withColumn("decision", decide(F.col("threshold"), margin)).withColumn("reason", _reason()).withColumn("evaluation", F.lit(evaluation))


def pair_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance_km", F.round(distance_km(
        F.col("l_latitude"), F.col("l_longitude"), F.col("r_latitude"), F.col("r_longitude")), 3))


