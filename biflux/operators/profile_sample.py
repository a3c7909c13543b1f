"""Draw a smaller profile whose metrics stay close to the original."""

from pyspark.sql import Column, DataFrame, Row, functions as F

from biflux.functions.draws import draw_bits, uniform
from biflux.functions.scalars import size_class
from biflux.operators.profile_metrics import (
    DEFAULT_THRESHOLD, DEFAULT_WINDOW, Span, fitness, metric_diff, metric_table, profile_span, raw_sums,
)
from biflux.runtime import durable
from biflux.schemas import FlowDataError
from biflux.skew import keyed_scan


STRATUM = ["l3_proto", "l4_proto", "_size", "_window"]


def _rates(smallest: float, largest: float, candidates: int) -> list[float]:
    """Sampling rates spread inside the allowed sizes, away from both ends."""
    return [smallest + (largest - smallest) * (i + 1) / (candidates + 1) for i in range(candidates)]


def _ranked(profile: DataFrame, row_id: str, seed: int, span: Span, window_length: int, heavy: list[Row] | None = None) -> DataFrame:
    """Number the rows of each stratum (address version, protocol, packet size class, start window) in hash order."""
    window = F.floor((F.col("start_time") - span.first) / (window_length * 1000))
    rows = profile.withColumns({
        "_size": size_class(F.col("bytes") + F.col("bytes_rev"), F.col("packets") + F.col("packets_rev")),
        "_window": window, "_order": draw_bits(seed, F.col(row_id), "sample"),
    })
    slot = {"_slot": F.shiftright("_order", 48)}
    return keyed_scan(rows, STRATUM, ["_order", row_id], slot, total={"_rank": F.lit(1)}, heavy=heavy)


def _member(candidate: int, rate: float, seed: int) -> Column:
    """Every ``1 / rate``-th row of a stratum, from an offset of its own per stratum and candidate."""
    phase = uniform(seed, *[F.col(c) for c in STRATUM], candidate)
    return F.floor((F.col("_rank") + 1) * rate + phase) > F.floor(F.col("_rank") * rate + phase)


def _candidates(profile: DataFrame, row_id: str, smallest: float, largest: float, candidates: int, seed: int,
                window_length: int) -> tuple[DataFrame, dict[int, Column], Span]:
    """The ranked rows, the condition of each candidate on them, and the span."""
    if not 0 < smallest <= largest <= 1:
        raise FlowDataError("sample size must be within 0..1")
    span = profile_span(profile, window_length)
    ranked = _ranked(profile, row_id, seed, span, window_length)
    return ranked, {i: _member(i, r, seed) for i, r in enumerate(_rates(smallest, largest, candidates))}, span


def score_candidates(
    profile: DataFrame,
    row_id: str,
    smallest: float,
    largest: float,
    deviation: float = 0.005,
    candidates: int = 16,
    seed: int = 0,
    proto_threshold: float = DEFAULT_THRESHOLD,
    port_threshold: float = DEFAULT_THRESHOLD,
    window_length: int = DEFAULT_WINDOW,
) -> DataFrame:
    """``candidate, share, fitness, worst, accepted`` for seeded stratified samples, all scored in one aggregation."""
    ranked, members, span = _candidates(profile, row_id, smallest, largest, candidates, seed, window_length)
    return _bounded_scores(
        profile, ranked, members, span, smallest, largest, deviation=deviation, proto_threshold=proto_threshold,
        port_threshold=port_threshold, window_length=window_length)


def _bounded_scores(profile: DataFrame, ranked: DataFrame, members: dict[int, Column], span: Span, smallest: float, largest: float,
                    **options) -> DataFrame:
    scores = score_members(profile, ranked, members, span, **options)
    return scores.withColumn("accepted", F.col("accepted") & F.col("share").between(smallest, largest))


def score_members(
    profile: DataFrame, rows: DataFrame, members: dict[int, Column], span: Span, deviation: float = 0.005,
    proto_threshold: float = DEFAULT_THRESHOLD, port_threshold: float = DEFAULT_THRESHOLD, window_length: int = DEFAULT_WINDOW,
) -> DataFrame:
    """``candidate, share, fitness, worst, accepted`` of samples given as conditions on ``rows`` (the profile, with any
    columns the conditions need). The sums of the profile and of all candidates come from one scan of ``rows``."""
    sums = durable(raw_sums(rows, span, window_length, members))
    whole, parts = sums.where("candidate IS NULL").drop("candidate"), sums.where("candidate IS NOT NULL")
    original = metric_table(profile, span, proto_threshold, port_threshold, window_length, sums=whole)
    # Small tables (metrics per candidate), each used more than once.
    scored = durable(metric_table(rows, span, 0.0, 0.0, window_length, members, totals=True, sums=parts))
    result = fitness(metric_diff(original, scored, [*members]), deviation, ["candidate"])
    size = scored.where((F.col("grp") == "total") & (F.col("name") == "flows")).select("candidate", F.col("value").alias("flows"))
    flows = whole.where((F.col("grp") == "total") & (F.col("name") == "flows")).select("amount")
    share = F.col("flows") / flows.scalar()
    return result.join(size, "candidate").select("candidate", share.alias("share"), "fitness", "worst", "accepted")


def sample(
    profile: DataFrame, row_id: str, smallest: float, largest: float, candidates: int = 16, seed: int = 0,
    window_length: int = DEFAULT_WINDOW, **options,
) -> tuple[DataFrame, Row]:
    """Best sample and its score row. A sample that meets all bounds wins; otherwise the fittest one, not accepted."""
    ranked, members, span = _candidates(profile, row_id, smallest, largest, candidates, seed, window_length)
    scores = _bounded_scores(profile, ranked, members, span, smallest, largest, window_length=window_length, **options)
    fits = F.col("share").between(smallest, largest)
    best = scores.orderBy(F.col("accepted").desc(), fits.desc(), F.col("fitness").desc(), F.col("worst"), "candidate").first()
    return ranked.where(members[best["candidate"]]).select(*profile.columns), best


def sample_report(original: DataFrame, chosen: DataFrame, window_length: int = DEFAULT_WINDOW,
                  proto_threshold: float = DEFAULT_THRESHOLD, port_threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Original, solution and difference per metric, plus the packet and byte totals of the sample."""
    span = profile_span(original, window_length)
    metrics = metric_table(original, span, proto_threshold, port_threshold, window_length)
    diff = metric_diff(metrics, metric_table(chosen, span, 0.0, 0.0, window_length))
    totals = raw_sums(chosen, span, window_length).where(F.col("grp") == "total").select(
        "grp", "name", F.lit(None).cast("double").alias("original"), F.col("amount").alias("solution"),
        F.lit(None).cast("double").alias("diff"))
    return diff.unionByName(totals)
