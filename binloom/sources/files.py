"""Readers of the text formats around binned tracks, regions, genes and association results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.operators.scan import Running, running
from binloom.operators.tables import require_columns, variant_place
from binloom.params import DEFAULTS, MARKS
from binloom.session import shared_folder

INTERVAL = "chrom string, start int, end int"


def tsv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = False, null: str = "NA") -> DataFrame:
    """Tab separated file, plain or gzip, with an explicit schema."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header, nullValue=null, mode="FAILFAST")


def read_windows(spark: SparkSession, path: str, bin_size: int = DEFAULTS.bin_size) -> DataFrame:
    """Header-less window BED with the bin number of each window."""
    return tsv(spark, path, INTERVAL).withColumn("bin", F.floor(F.col("start") / bin_size).cast("long"))


def read_deposit(
    spark: SparkSession, path: str, stage: str, marks: Sequence[str] = MARKS, bin_size: int = DEFAULTS.bin_size
) -> DataFrame:
    """Matrix with coordinates: chr, start, end and one 0/1 column per mark, with a header.

    The coordinates are the key, so nothing depends on row order. A gzip file is read by
    one task; ``store_bins`` rewrites it once as partitioned Parquet.
    """
    kinds = ", ".join(f"`{m}` tinyint" for m in marks)
    names = spark.read.text(path).first()[0].split("\t")
    if names[3:] != list(marks):
        raise ValueError(f"mark columns differ: {names[3:]}")
    frame = tsv(spark, path, f"{INTERVAL}, {kinds}", header=True)
    return frame.select(
        "chrom", F.floor(F.col("start") / bin_size).cast("long").alias("bin"), F.lit(stage).alias("stage"), *marks
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their byte offset, the only order a file has."""
    lines = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.hadoop.mapreduce.lib.input.TextInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.Text",
    )
    return spark.createDataFrame(lines, "offset long, line string")


def row_numbers(df: DataFrame, offset: str = "offset") -> DataFrame:
    """Consecutive numbers from 1 in offset order."""
    counted = running(df.withColumn("_one", F.lit(1)), [], offset, [Running("row", "sum", "_one")], 1 << 22)
    return counted.drop("_one")


def read_binary_matrix(spark: SparkSession, path: str, marks: Sequence[str] = MARKS) -> DataFrame:
    """Matrix without coordinates: marks plus the row number that aligns it to the windows."""
    lines = numbered_lines(spark, path)
    head = lines.filter("offset = 0").first()["line"].split("\t")
    if head != list(marks):
        raise ValueError(f"mark columns differ: {head}")
    fields = F.split("line", "\t")
    numbered = row_numbers(lines.filter("offset > 0"))
    return numbered.select("row", *[fields[i].cast("tinyint").alias(m) for i, m in enumerate(marks)])


def align_matrix(windows_path: str, matrix: DataFrame, stage: str, bin_size: int = DEFAULTS.bin_size) -> DataFrame:
    """Attach the coordinates of row-aligned windows to a matrix; row counts must agree."""
    spark = matrix.sparkSession
    windows = row_numbers(numbered_lines(spark, windows_path))
    n_windows, n_rows = windows.count(), matrix.count()
    if n_windows != n_rows:
        raise ValueError(f"{n_windows} windows but {n_rows} matrix rows")
    fields = F.split("line", "\t")
    placed = windows.select(
        "row", fields[0].alias("chrom"), F.floor(fields[1].cast("long") / bin_size).cast("long").alias("bin")
    )
    return placed.join(matrix, "row").drop("row").withColumn("stage", F.lit(stage))


def check_stages(bins: DataFrame) -> DataFrame:
    """Raise unless every stage has the same number of windows."""
    counts = {row["stage"]: row["count"] for row in bins.groupBy("stage").count().collect()}  # few stages
    if len(set(counts.values())) > 1:
        raise ValueError(f"stages differ in windows: {counts}")
    return bins


def tiling_gaps(windows: DataFrame, bin_size: int = DEFAULTS.bin_size) -> DataFrame:
    """Chromosomes whose windows are not one contiguous tiling from 0."""
    shape = windows.groupBy("chrom").agg(
        F.min("start").alias("first"),
        F.max("end").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("start").alias("n_distinct"),
        F.bool_and((F.col("end") - F.col("start") == bin_size) & (F.col("start") % bin_size == 0)).alias("regular"),
    )
    good = (
        (F.col("first") == 0) & F.col("regular") & (F.col("n") == F.col("n_distinct"))
        & (F.col("last") == F.col("n") * bin_size)
    )
    return shape.filter(~good)


def store_bins(bins: DataFrame, path: str) -> DataFrame:
    """Write bins as Parquet split by stage and chromosome, once; later calls read it."""
    spark = bins.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        bins.repartitionByRange("stage", "chrom", "bin").write.mode("overwrite").partitionBy("stage", "chrom").parquet(path)
    return spark.read.parquet(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3/BED4 regions in file order with ``input_order`` and a name.

    Blank lines, comments, ``track`` and ``browser`` lines and a header line are skipped;
    malformed or empty intervals raise. Names default to ``chrom:start:end``.
    """
    fields = F.split("line", "\t")
    lines = numbered_lines(spark, path)
    text = lines.filter((F.trim("line") != "") & ~F.col("line").rlike("^(#|track|browser)"))
    header = (F.col("offset") == 0) & fields[1].try_cast("long").isNull() & fields[2].try_cast("long").isNull()
    start, end = fields[1].try_cast("long"), fields[2].try_cast("long")
    bad = start.isNull() | end.isNull() | (start < 0) | (end <= start)
    complaint = F.raise_error(F.concat(F.lit("bad region: "), F.col("line"))).cast("long")
    name = F.get(fields, F.lit(3))
    place = F.concat_ws(":", fields[0], start.cast("string"), end.cast("string"))
    rows = row_numbers(text.filter(~header))
    return rows.select(
        F.col("row").alias("input_order"),
        fields[0].alias("chrom"),
        F.when(bad, complaint).otherwise(start).alias("start"),
        end.alias("end"),
        F.when(name.isNull() | (F.trim(name) == ""), place).otherwise(name).alias("name"),
    )


def read_gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts and exons (closed coordinates) of a GTF or GFF3 annotation."""
    schema = (
        "chrom string, source string, feature string, start long, end long, score string, strand string, "
        "frame string, attributes string"
    )
    rows = spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="")

    def attribute(name: str) -> Column:
        found = F.regexp_extract("attributes", f'(?:^|;)\\s*{name}[ =]"?([^";]+)"?', 1)
        return F.when(found != "", found)

    parent = F.regexp_replace(attribute("Parent"), "^transcript:", "")
    tagged = rows.select(
        "chrom", "feature", "start", "end", "strand",
        attribute("gene_id").alias("gene_id"),
        F.coalesce(attribute("transcript_id"), parent).alias("tx_id"),
    )
    columns = ("chrom", "start", "end", "strand", "gene_id", "tx_id")
    transcripts = tagged.filter(F.col("feature").isin("transcript", "mRNA")).select(*columns)
    exons = tagged.filter("feature = 'exon'").select(*columns)
    genes = transcripts.select("tx_id", F.col("gene_id").alias("_gene")).distinct()
    exons = exons.join(genes, "tx_id", "left").withColumn("gene_id", F.coalesce("gene_id", "_gene")).select(*columns)
    return transcripts, exons


def read_fasta(spark: SparkSession, path: str, chunk: int = 4096) -> DataFrame:
    """Sequences as (chrom, chunk, seq): fixed-size pieces, so no row holds a chromosome."""
    lines = numbered_lines(spark, path)
    named = lines.withColumn("_head", F.when(F.col("line").startswith(">"), F.col("offset")))
    placed = running(named, [], "offset", [Running("_at", "last", "_head")], 1 << 22)
    names = placed.filter(F.col("_head").isNotNull()).select(
        F.col("offset").alias("_at"), F.element_at(F.split(F.expr("substring(line, 2)"), "\\s+"), 1).alias("chrom")
    )
    body = placed.filter(F.col("_head").isNull()).withColumn("n", F.length(F.trim("line")).cast("long"))
    located = running(body.select("_at", "offset", "line", "n"), ["_at"], "offset", [Running("_end", "sum", "n")], 1 << 22)
    begin = F.col("_end") - F.col("n")
    pieces = located.join(names, "_at").select(
        "chrom", begin.alias("begin"), F.trim("line").alias("line"),
        F.explode(F.sequence(F.floor(begin / chunk), F.floor((F.col("_end") - 1) / chunk))).alias("chunk"),
    )
    low = F.greatest(F.col("chunk") * chunk - F.col("begin"), F.lit(0))
    high = F.least((F.col("chunk") + 1) * chunk - F.col("begin"), F.length("line").cast("long"))
    cut = pieces.select("chrom", "chunk", "begin", F.substring("line", (low + 1).cast("int"), (high - low).cast("int")).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("begin", "s")))
    return cut.groupBy("chrom", "chunk").agg(F.array_join(F.transform(ordered, lambda p: p["s"]), "").alias("seq"))


def read_signal_matrix(spark: SparkSession, path: str, first: int = 101, count: int = 100) -> DataFrame:
    """Numeric rows of a signal matrix (three header lines) with the mean of a column slice."""
    rows = row_numbers(numbered_lines(spark, path)).filter("row > 3")
    values = F.transform(F.split("line", "\t"), lambda v: v.try_cast("double"))
    window = F.slice(values, first, count)
    total = F.aggregate(F.filter(window, lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)
    return rows.select((F.col("row") - 3).alias("row"), values.alias("signal"), (total / count).alias("mean"))


def read_heritability(spark: SparkSession, results: str, log: str) -> DataFrame:
    """Partitioned heritability results with the total observed heritability of the log."""
    frame = spark.read.csv(results, sep="\t", header=True, inferSchema=True)
    needed = ("Category", "Prop._SNPs", "Enrichment_p", "Coefficient", "Coefficient_std_error")
    require_columns(frame, *needed)
    found = (
        spark.read.text(log).filter(F.col("value").startswith("Total Observed scale h2:"))
        .select(F.regexp_extract("value", r"h2:\s*([-+0-9.eE]+)", 1).try_cast("double").alias("h2")).take(2)
    )
    if len(found) != 1 or not found[0]["h2"] or not 0 < found[0]["h2"] < float("inf"):
        raise ValueError("the log needs exactly one positive heritability line")
    return frame.select(
        F.col("Category").alias("category"),
        F.col("`Prop._SNPs`").cast("double").alias("prop_snps"),
        F.col("Enrichment_p").cast("double").alias("enrichment_p"),
        F.col("Coefficient").cast("double").alias("coefficient"),
        F.col("Coefficient_std_error").cast("double").alias("coefficient_se"),
        F.lit(found[0]["h2"]).alias("h2"),
    )


def read_eqtl(spark: SparkSession, path: str) -> DataFrame:
    """eQTL table (variant_id, gene_id, ...) with its half-open point interval."""
    frame = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    chrom, position = variant_place("variant_id")
    return frame.withColumn("chrom", chrom).withColumn("start", position).withColumn("end", position + 1)


def read_expression(spark: SparkSession, path: str, gene: str = "gene_id") -> DataFrame:
    """Wide expression table as long (gene_id, sample, tpm)."""
    frame = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    samples = [c for c in frame.columns if c != gene]
    doubles = frame.select(F.col(gene).alias("gene_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in samples])
    return doubles.unpivot(["gene_id"], samples, "sample", "tpm")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """Motif enrichment table with ``p`` from the natural log p column."""
    frame = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    log_p = next(c for c in frame.columns if c.lower().startswith("log p"))
    return frame.withColumn("p", F.exp(F.col(f"`{log_p}`").cast("double")))


def write_tsv(df: DataFrame, path: str, header: bool = True, null: str = "NA") -> None:
    """Tab separated folder of part files."""
    df.write.csv(path, sep="\t", header=header, nullValue=null, emptyValue="", quote="", mode="overwrite")


def write_cells(df: DataFrame, path: str, keys: Sequence[str], values: Sequence[str]) -> None:
    """``Method,Value`` rows, one folder per combination of ``keys``."""
    doubles = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    long = doubles.unpivot(list(keys), list(values), "Method", "Value")
    long.write.partitionBy(*keys).csv(path, header=True, mode="overwrite")


def write_controls(controls: DataFrame, unmatched: DataFrame, path: str) -> bool:
    """Control table (shares with six digits) and, next to it, the unmatched pairs.

    Returns whether every pair was matched; an empty unmatched table replaces a stale one.
    """
    shares = ("source_gc", "control_gc", "gc_difference")
    text = controls.withColumns({c: F.format_string("%.6f", c) for c in shares})
    write_tsv(text, path)
    write_tsv(unmatched, f"{path}.unmatched")
    return unmatched.isEmpty()


def store_table(df: DataFrame, name: str, refresh: bool = False) -> DataFrame:
    """Named intermediate table in the shared folder, written when missing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if refresh or not files.exists(target):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
