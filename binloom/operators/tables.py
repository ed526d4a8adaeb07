"""Table operators: classifications, grouped summaries, reshaping, set flows, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from binloom.functions import tails
from binloom.functions.columns import clipped, ratio
from binloom.params import CHROMS, DEFAULTS, STAGES

# ---- classifications ---------------------------------------------------------------


def length_band(length: Column) -> Column:
    """1, 2-5, 6-10, 11-20, >20 bins."""
    return (
        F.when(length <= 1, "1").when(length <= 5, "2-5").when(length <= 10, "6-10")
        .when(length <= 20, "11-20").otherwise(">20")
    )


def bin_state(active: Column, repressive: Column) -> Column:
    return (
        F.when((active == 1) & (repressive == 1), "Bivalent").when(active == 1, "ac_only")
        .when(repressive == 1, "me3_only").otherwise("None")
    )


def expression_change(log2fc: Column, padj: Column) -> Column:
    significant = padj < DEFAULTS.de_padj
    return (
        F.when(significant & (log2fc >= DEFAULTS.de_log2fc), "Up")
        .when(significant & (log2fc <= -DEFAULTS.de_log2fc), "Down").otherwise("NotSig")
    )


def coverage_change(delta: Column) -> Column:
    return F.when(delta <= -0.2, "reduced").when(delta >= 0.2, "rised").otherwise("keeped")


def quadrant(x: Column, y: Column, strict: bool = False) -> Column:
    """Quadrant by sign; zero counts as low, or as high with ``strict`` lows."""
    low_x, low_y = (x < 0, y < 0) if strict else (x <= 0, y <= 0)
    return F.concat(F.when(low_x, "x-").otherwise("x+"), F.when(low_y, "y-").otherwise("y+"))


def membership_label(flags: Mapping[str, Column]) -> Column:
    """Names of the true flags concatenated, e.g. 1, 13 or 123."""
    return F.concat_ws("", *[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def signed_log_p(p: Column, sign: Column, floor: float = 2.2e-16, cap: float | None = None) -> Column:
    """``-log10 p`` with a floor on p, optionally capped, times the sign of the effect."""
    value = -F.log10(F.greatest(p, F.lit(floor)))
    if cap is not None:
        value = F.least(value, F.lit(cap))
    return value * F.signum(sign)


def log2_fold(a: Column, b: Column, pseudo: float = 1.0) -> Column:
    return F.log2(a + pseudo) - F.log2(b + pseudo)


# ---- keys, names, order ------------------------------------------------------------


def genome_rank(chrom: Column, chroms: Sequence[str] = CHROMS) -> Column:
    """Position of a chromosome in genome order; unknown names come last."""
    order = F.array(*map(F.lit, chroms))
    place = F.array_position(order, chrom)
    return F.when(place > 0, place).otherwise(len(chroms) + 1)


def genome_order(df: DataFrame, chroms: Sequence[str] = CHROMS) -> DataFrame:
    return df.orderBy(genome_rank(F.col("chrom"), chroms), "chrom", "start", "end")


def harmonise_chrom(df: DataFrame, like: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Add or remove the ``chr`` prefix so that names follow the majority of ``like``."""
    share = like.agg(F.avg(F.col(chrom).startswith("chr").cast("double"))).scalar()
    bare = F.regexp_replace(chrom, "^chr", "")
    plain = F.when(bare == "M", "MT").otherwise(bare)
    prefixed = F.concat(F.lit("chr"), F.when(bare == "MT", "M").otherwise(bare))
    return df.withColumn(chrom, F.when(share > 0.5, prefixed).otherwise(plain))


def on_known_chroms(df: DataFrame, known: DataFrame, chrom: str = "chrom") -> DataFrame:
    return df.join(known.select(chrom).distinct(), chrom, "left_semi")


def recode(df: DataFrame, column: str, mapping: DataFrame, code: str, label: str) -> DataFrame:
    """Replace codes by their label where one is defined."""
    lookup = mapping.select(F.col(code).alias(column), F.col(label).alias("_label"))
    return df.join(lookup, column, "left").withColumn(column, F.coalesce("_label", column)).drop("_label")


def first_match(df: DataFrame, lookup: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Left join to the first row (by ``order``) of every key of ``lookup``."""
    first = lookup.groupBy(key).agg(F.min_by(value, order).alias(value))
    return df.join(first, key, "left")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in ``order``; the aggregation keeps one row per map task and key."""
    payload = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per group; Spark limits groups before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def require_columns(df: DataFrame, *needed: str) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_known(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Same rows; a blank or undefined category raises while the rows are read."""
    bad = F.col(column).isNull() | (F.trim(column) == "") | ~F.col(column).isin(*known)
    complaint = F.raise_error(F.concat(F.lit(f"undefined {column}: "), F.coalesce(column, F.lit("NULL"))))
    return df.withColumn(column, F.when(bad, complaint.cast("string")).otherwise(F.col(column)))


def ratio_text(column: str) -> tuple[Column, Column]:
    """Numerator and denominator of text such as ``5/120``; NULL where malformed."""
    parts = F.split(column, "/")
    return F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")


def variant_place(column: str) -> tuple[Column, Column]:
    """Chromosome and position of ``chr1_12345_A_G_b38`` style ids."""
    parts = F.split(column, "_")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("long")


# ---- grouped summaries -------------------------------------------------------------


def counts_with_share(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows per key and their share of the total of ``within``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return add_share(counts, within)


def add_share(counts: DataFrame, within: Sequence[str] = (), n: str = "n") -> DataFrame:
    if within:
        totals = counts.groupBy(*within).agg(F.sum(n).alias("_total"))
        joined = counts.join(totals, list(within))
    else:
        joined = counts.withColumn("_total", counts.agg(F.sum(n)).scalar())
    return joined.select(*counts.columns, ratio(F.col(n), F.col("_total")).alias("share"))


def mean_sem(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL share, variance, finite count and zero share of every column, one row each."""
    stats = []
    for c in columns:
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                ratio(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("na_fraction"),
                F.var_samp(c).alias("variance"),
                F.count(c).alias("n_finite"),
                ratio(F.count_if(F.col(c) == 0), F.count(c)).alias("zero_fraction"),
            ).alias(f"_{c}")
        )
    row = df.agg(*stats)
    return row.select(F.explode(F.array(*[F.col(f"`_{c}`") for c in columns])).alias("_p")).select("_p.*")


def composition(df: DataFrame, keys: Sequence[str], category: str, domain: DataFrame, length: Column) -> DataFrame:
    """Count, covered length and share per key and category, zero-filled over the domain."""
    found = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("covered"))
    names = domain.select(F.collect_set(category)).scalar()
    full = (
        df.select(*keys).distinct().withColumn(category, F.explode(names)).join(found, [*keys, category], "left")
    )
    zero = F.lit(0).cast("long")
    filled = full.select(
        *keys, category, F.coalesce("n", zero).alias("n"), F.coalesce("covered", zero).alias("covered")
    )
    return add_share(filled, keys, "covered")


def density_per_kb(hits: DataFrame, keys: Sequence[str], count: str, length: Column) -> DataFrame:
    return hits.groupBy(*keys).agg(
        F.sum(count).alias("n"), ratio(F.sum(count), F.sum(length) / 1000).alias("per_kb")
    )


def scaled_to_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value as a share of the range of its key, limited to [0, 1]."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    share = ratio(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    return df.join(limits, list(keys)).select(
        *df.columns, clipped(share, F.lit(0.0), F.lit(1.0)).alias("scaled")
    )


def z_within(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Standard score of a value within its key."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(moments, list(keys)).select(
        *df.columns, ratio(F.col(value) - F.col("_m"), F.col("_s")).alias("z")
    )


def joined_text(df: DataFrame, keys: Sequence[str], value: str, separator: str = ",") -> DataFrame:
    """Distinct values of a small group, sorted and joined."""
    return df.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), separator).alias(value)
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(value) / width).cast("long").alias("bin_no")).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- stage paths and set flows -----------------------------------------------------


def presence_paths(words: DataFrame, mark: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """Bins per presence path over the stages (all but the empty path), from packed bins."""
    masks = [F.col(f"{mark}_{s}") for s in stages]
    counts = []
    for path in product("01", repeat=len(stages)):
        if "1" not in path:
            continue
        picked = reduce(
            Column.bitwiseAND, [m if f == "1" else F.bitwise_not(m) for m, f in zip(masks, path)]
        )
        label = F.lit("".join(path)).alias("path")
        counts.append((label, F.sum(F.bit_count(picked).cast("long")), f"_{''.join(path)}"))
    row = words.agg(*[total.alias(name) for _, total, name in counts])
    cells = F.array(*[F.struct(label, F.col(name).alias("n")) for label, _, name in counts])
    return row.select(F.explode(cells).alias("_c")).select("_c.*")


def state_paths(
    words: DataFrame, active: str, repressive: str, stages: Sequence[str] = STAGES
) -> DataFrame:
    """Bins per path of states (see ``bin_state``), except the path without any mark."""
    states = {}
    for s in stages:
        a, m = F.col(f"{active}_{s}"), F.col(f"{repressive}_{s}")
        states[s] = {
            "Bivalent": a.bitwiseAND(m),
            "ac_only": a.bitwiseAND(F.bitwise_not(m)),
            "me3_only": m.bitwiseAND(F.bitwise_not(a)),
            "None": F.bitwise_not(a.bitwiseOR(m)),
        }
    names = ("Bivalent", "ac_only", "me3_only", "None")
    totals, cells = [], []
    for i, path in enumerate(product(names, repeat=len(stages))):
        if set(path) == {"None"}:
            continue
        picked = reduce(Column.bitwiseAND, [states[s][state] for s, state in zip(stages, path)])
        totals.append(F.sum(F.bit_count(picked).cast("long")).alias(f"_{i}"))
        cells.append(
            F.struct(*[F.lit(state).alias(s) for s, state in zip(stages, path)], F.col(f"_{i}").alias("n"))
        )
    return (
        words.agg(*totals).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").filter("n > 0")
    )


def frequent_paths(paths: DataFrame, share: float = 0.005) -> DataFrame:
    """Paths holding at least ``share`` of all counted bins."""
    return add_share(paths).filter(F.col("share") >= share)


def membership(df: DataFrame, key: str, stage: str = "stage", stages: Sequence[str] = STAGES) -> DataFrame:
    """One row per key with a flag ``in_<stage>`` per stage."""
    return df.groupBy(key).agg(*[F.bool_or(F.col(stage) == s).alias(f"in_{s}") for s in stages])


def inheritance_flows(members: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Retained, lost and new keys at every step from one stage to the next."""
    cells, totals = [], []
    for before, after in zip(stages, stages[1:]):
        was, now = F.col(f"in_{before}"), F.col(f"in_{after}")
        for flow, test in (("retained", was & now), ("lost", was & ~now), ("new", ~was & now)):
            name = f"_{before}_{after}_{flow}"
            totals.append(F.count_if(test).alias(name))
            cells.append(
                F.struct(F.lit(f"{before}_{after}").alias("step"), F.lit(flow).alias("flow"), F.col(name).alias("n"))
            )
    return members.agg(*totals).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


# ---- association summaries ---------------------------------------------------------


def tau_star(df: DataFrame, m: int = DEFAULTS.ldsc_m) -> DataFrame:
    """Standardised per-SNP heritability: needs prop_snps, coefficient, coefficient_se, h2.

    ``z`` and the two-sided ``p`` are those of the coefficient, so they hold also where the
    share of SNPs is 0 or 1.
    """
    spread = F.sqrt(F.col("prop_snps") * (1 - F.col("prop_snps")))
    unit = ratio(m * spread, F.col("h2"))
    z = ratio(F.col("coefficient"), F.col("coefficient_se"))
    return df.withColumn("tau_star", unit * F.col("coefficient")).withColumn(
        "tau_star_se", F.abs(unit) * F.col("coefficient_se")
    ).withColumn("z", z).withColumn("p", tails.normal_two_sided("z")).withColumn(
        "ci_low", F.col("tau_star") - 1.96 * F.col("tau_star_se")
    ).withColumn("ci_high", F.col("tau_star") + 1.96 * F.col("tau_star_se"))


# ---- order and gene sets -----------------------------------------------------------


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows by the order columns (a top-k report)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def first_appearance(df: DataFrame, value: str, order: str, name: str = "level") -> DataFrame:
    """Distinct values numbered 1, 2, ... by the smallest ``order`` they occur at; for factor levels."""
    seen = df.groupBy(value).agg(F.min(order).alias("_first"))  # one row per level
    return seen.select(value, F.row_number().over(Window.orderBy("_first", value)).cast("long").alias(name))


def restricted_to(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows that overlap a region; an error if there are none."""
    found = df.filter((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    if found.isEmpty():
        raise ValueError(f"nothing overlaps {chrom}:{start}-{end}")
    return found


def fate_shares(df: DataFrame, group: str, gene: str, change: str, expressed: str) -> DataFrame:
    """Shares of a group's distinct genes that fall, stay, rise, or are expressed nowhere (``silent``)."""
    total = F.count_distinct(gene)
    part = lambda test: ratio(F.count_distinct(F.when(test, F.col(gene))), total)
    return df.groupBy(group).agg(
        total.alias("n"),
        part(F.col(change) == "Down").alias("repressed"),
        part(F.col(change) == "NotSig").alias("unchanged"),
        part(F.col(change) == "Up").alias("induced"),
        part(~F.coalesce(F.col(expressed), F.lit(False))).alias("silent"),
    )
