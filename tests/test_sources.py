"""Readers, sinks, gene assignment and sequence composition on small files."""

import gzip

import pytest

from binloom.functions.sequence import region_composition
from binloom.operators import genes
from binloom.params import MARKS
from binloom.sources import files


def save(tmp_path, name, text):
    path = tmp_path / name
    if name.endswith(".gz"):
        with gzip.open(path, "wt") as out:
            out.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_matrix_readers_agree(spark, tmp_path):
    rows = [("chr1", 200 * i, 200 * i + 200, [(i + j) % 2 for j in range(8)]) for i in range(5)]
    head = "\t".join(MARKS)
    deposit = save(tmp_path, "d.tsv.gz", f"chr\tstart\tend\t{head}\n" + "".join(
        "\t".join(map(str, (c, s, e, *m))) + "\n" for c, s, e, m in rows))
    windows = save(tmp_path, "w.bed", "".join(f"{c}\t{s}\t{e}\n" for c, s, e, _ in rows))
    matrix = save(tmp_path, "m.tsv.gz", head + "\n" + "".join("\t".join(map(str, m)) + "\n" for *_, m in rows))
    keyed = files.read_deposit(spark, deposit, "d0")
    aligned = files.align_matrix(windows, files.read_binary_matrix(spark, matrix), "d0")
    order = ["chrom", "bin", "stage", *MARKS]
    assert sorted(keyed.select(order).collect()) == sorted(aligned.select(order).collect())
    assert files.tiling_gaps(files.read_windows(spark, windows)).count() == 0
    stored = files.store_bins(keyed, str(tmp_path / "bins"))
    assert stored.count() == 5 and files.store_bins(keyed, str(tmp_path / "bins")).count() == 5


def test_bed(spark, tmp_path):
    path = save(tmp_path, "r.bed", "chrom\tstart\tend\tname\n# note\ntrack x\nchr1\t10\t20\t\nchr2\t5\t9\tn2\n")
    got = [tuple(r) for r in files.read_bed(spark, path).orderBy("input_order").collect()]
    assert got == [(1, "chr1", 10, 20, "chr1:10:20"), (2, "chr2", 5, 9, "n2")]
    bad = save(tmp_path, "bad.bed", "chr1\t10\t10\n")
    with pytest.raises(Exception, match="bad region"):
        files.read_bed(spark, bad).collect()


def test_gtf_assignment(spark, tmp_path):
    def line(feature, start, end, strand, gene, tx):
        return f'chr1\tt\t{feature}\t{start}\t{end}\t.\t{strand}\t.\tgene_id "{gene}"; transcript_id "{tx}";\n'

    text = line("transcript", 10001, 20000, "+", "G1", "T1") + line("exon", 10001, 11000, "+", "G1", "T1")
    text += line("exon", 15001, 20000, "+", "G1", "T1") + line("transcript", 100000, 120000, "-", "G2", "T2")
    text += line("exon", 100000, 120000, "-", "G2", "T2")
    transcripts, exons = files.read_gtf(spark, save(tmp_path, "a.gtf.gz", text))
    assert [tuple(r) for r in genes.introns(exons).collect()] == [("chr1", 11001, 15000, "G1")]
    regions = [
        ("p", 9000, 9500), ("e", 16000, 16100), ("i", 13000, 13100), ("d", 30000, 30100), ("f", 900000, 900100),
        ("m", 121000, 121500),
    ]
    bed = spark.createDataFrame([(n, "chr1", s, e, i) for i, (n, s, e) in enumerate(regions, 1)],
                                "name string, chrom string, start long, end long, input_order long")
    detail, targets = genes.annotate_regions(genes.numbered_regions(bed, "input_order"), transcripts, exons)
    got = {r["name"]: (r["target_gene_id"], r["final_type"], r["final_distance"]) for r in targets.collect()}
    assert got == {
        "p": ("G1", "promoter", 501), "e": ("G1", "exon", 6000), "i": ("G1", "intron", 3000),
        "d": ("G1", "distal_regulatory", 20000), "f": ("None", "intergenic_far", None), "m": ("G2", "promoter", 1001),
    }
    assert detail.count() == 6


def test_fasta_composition(spark, tmp_path):
    path = save(tmp_path, "g.fa", ">c1 first\nACGTAC\nGGGGNN\nTT\n>c2\nAAAA\n")
    chunks = files.read_fasta(spark, path, chunk=5)
    seqs = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["chrom"], r["chunk"])):
        seqs[r["chrom"]] = seqs.get(r["chrom"], "") + r["seq"]
    assert seqs == {"c1": "ACGTACGGGGNNTT", "c2": "AAAA"}
    regions = spark.createDataFrame([("c1", 4, 13), ("c2", 0, 4)], "chrom string, start long, end long")
    got = {r["chrom"]: (r["gc"], r["n_fraction"], r["n_bases"]) for r in region_composition(regions, chunks, 5).collect()}
    assert got["c1"] == pytest.approx((5 / 7, 2 / 9, 9)) and got["c2"] == (0.0, 0.0, 4)


def test_association_tables(spark, tmp_path):
    results = save(tmp_path, "x.results", "Category\tProp._SNPs\tEnrichment_p\tCoefficient\tCoefficient_std_error\nA\t0.1\t0.01\t1e-9\t2e-9\n")
    log = save(tmp_path, "x.log", "start\nTotal Observed scale h2: 0.25 (0.01)\nend\n")
    row = files.read_heritability(spark, results, log).first()
    assert (row["category"], row["h2"]) == ("A", 0.25)
    eqtl = files.read_eqtl(spark, save(tmp_path, "e.tsv", "variant_id\tgene_id\nchr1_500_A_G_b38\tG1\n")).first()
    assert (eqtl["chrom"], eqtl["start"], eqtl["end"]) == ("chr1", 500, 501)
    signal = files.read_signal_matrix(spark, save(tmp_path, "s.tab", "#a\n#b\nh\n1\t2\t3\t4\n5\t6\t7\t8\n"), 2, 2)
    assert sorted(r["mean"] for r in signal.collect()) == [2.5, 6.5]
    out = str(tmp_path / "cells")
    files.write_cells(spark.createDataFrame([(1, 0.5, 2.0)], "k int, ch double, db double"), out, ["k"], ["ch", "db"])
    assert spark.read.csv(out, header=True).count() == 2
