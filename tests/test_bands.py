"""LD matrices, LD scores and allele frequencies from packed genotypes against numpy; genotype files by ranges."""

import numpy as np
import pytest

from quillon.operators import bands, ld
from quillon.sources import genetics
from quillon.sources.blocks import FormatError


def genotypes(snps, people, seed, missing=0.03):
    rng = np.random.default_rng(seed)
    base = rng.binomial(2, rng.uniform(0.02, 0.5, (snps, 1)), (snps, people))
    for k in range(1, snps):  # neighbours are alike
        same = rng.random(people) < 0.7
        base[k, same] = base[k - 1, same]
    base[rng.random(base.shape) < missing] = -1
    return base


def table(spark, g, chrom, bp, parts=3):
    rows = [(c, int(p), f"s{k}", [int(x) for x in row]) for k, (c, p, row) in enumerate(zip(chrom, bp, g, strict=True))]
    return spark.createDataFrame(rows, "CHR string, BP long, SNP string, genotypes array<int>").repartition(parts)


def brute_pairs(g, chrom, bp, window, least, maf, missing):
    out = {}
    fine = []
    for row in g:
        v = row[row >= 0]
        f = v.mean() / 2 if len(v) else 0
        fine.append(len(v) > 0 and min(f, 1 - f) >= maf and (row < 0).mean() <= missing)
    for i in range(len(g)):
        for j in range(len(g)):
            if i == j or not (fine[i] and fine[j]) or chrom[i] != chrom[j] or not (0 <= bp[j] - bp[i] <= window) or (bp[i] == bp[j] and i > j):
                continue
            both = (g[i] >= 0) & (g[j] >= 0)
            x, y = g[i][both].astype(float), g[j][both].astype(float)
            if len(x) and x.std() and y.std():
                r = np.corrcoef(x, y)[0, 1]
                if r * r >= least:
                    out[tuple(sorted((f"s{i}", f"s{j}")))] = (round(r, 9), int(both.sum()))
    return out


@pytest.mark.parametrize(("window", "block"), [(50, 512), (50, 7), (0, 512), (1000, 5)])
def test_ld_matrix_against_numpy(spark, monkeypatch, window, block):
    monkeypatch.setattr(bands, "BLOCK", block)
    rng = np.random.default_rng(2)
    g = genotypes(90, 37, 1)
    g[5] = -1
    g[6] = 1
    g[7, :20] = -1
    chrom = ["1"] * 60 + ["X"] * 30
    bp = np.concatenate([np.sort(rng.integers(-40, 400, 60)), np.sort(rng.integers(0, 90, 30))])
    got = bands.ld_matrix(table(spark, g, chrom, bp), window, least_r2=0.02, maf=0.05, missing=0.2).collect()
    assert all(r.BP <= r.BP_b and r.r2 == pytest.approx(r.r**2) for r in got) and len({(r.SNP, r.SNP_b) for r in got}) == len(got)
    want = brute_pairs(g, chrom, bp, window, 0.02, 0.05, 0.2)
    assert {tuple(sorted((r.SNP, r.SNP_b))): (round(r.r, 9), r.n) for r in got} == want


def test_ld_scores_by_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bands, "BLOCK", 4)
    g = genotypes(40, 50, 3)
    g[3] = 2
    bp = np.sort(np.random.default_rng(1).integers(0, 300, 40))
    d = table(spark, g, ["1"] * 40, bp)
    x = {}
    for k, row in enumerate(g):
        v = np.where(row >= 0, row - row[row >= 0].mean(), 0.0)
        if v.std() > 0:
            x[k] = v / np.sqrt((v * v).mean())
    for kind in ("unbiased", "r2", "r"):
        want = {}
        for a in x:
            r = np.array([np.mean(x[a] * x[b]) for b in x if abs(bp[a] - bp[b]) <= 60])
            want[f"s{a}"] = (r if kind == "r" else r * r if kind == "r2" else r * r - (1 - r * r) / 48).sum()
        assert {r.SNP: r.L2 for r in ld.ld_scores(d, 60, kind=kind).collect()} == pytest.approx(want)
    from pyspark.sql import functions as F

    both = ld.ld_scores(d.withColumns({"one": F.lit(1), "other": F.col("BP") / 100}), 60, ["one", "other"], kind="r2").collect()
    assert {r.SNP: r.oneL2 for r in both} == pytest.approx({r.SNP: r.L2 for r in ld.ld_scores(d, 60, kind="r2").collect()})


def test_no_row_holds_two_genotypes(spark):
    d = table(spark, genotypes(10, 8, 1), ["1"] * 10, range(10))
    plan = bands.ld_matrix(d, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_packing_and_frequencies(spark):
    g = np.array([[0, 1, 2, -1, 9], [2, 2, 2, 2, 2], [-1] * 5])
    assert (bands.unpack([x.tobytes() for x in bands.pack(g)], 5) == np.where((g < 0) | (g > 2), 3, g)).all()
    d = spark.createDataFrame([("1", 1, "a", [0, 1, 2, -1, None]), ("1", 2, "b", [2] * 5), ("1", 3, "c", [-1] * 5), ("1", 4, "d", None)], "CHR string, BP long, SNP string, genotypes array<int>")
    got = {r.SNP: (r.n, r.freq, r.maf, r.missing) for r in bands.allele_frequencies(d).collect()}
    assert got == {"a": (3, 0.5, 0.5, 0.4), "b": (5, 1.0, 0.0, 0.0), "c": (0, None, None, 1.0)}


def write_plink(folder, name, g, chrom):
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    raw = bytearray(b"\x6c\x1b\x01")
    for row in g.tolist():
        for k in range(0, len(row), 4):
            raw.append(sum(code[v] << (2 * i) for i, v in enumerate(row[k : k + 4])))
    (folder / f"{name}.bed").write_bytes(raw)
    (folder / f"{name}.bim").write_text("".join(f"{chrom} c{chrom}s{i} 0 {10 * i + 1} A G\n" for i in range(len(g))))
    (folder / f"{name}.fam").write_text("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(g.shape[1])))


def test_genotype_files_by_ranges(spark, tmp_path):
    per = {c: genotypes(5 + c, 13, c) for c in range(1, 23)}
    for c, g in per.items():
        write_plink(tmp_path, f"chr{c}", g, c)
    want = {f"c{c}s{i}": row.tolist() for c, g in per.items() for i, row in enumerate(g) if len(set(row[row >= 0].tolist())) > 1}
    for part_bytes in (1, 9, 1 << 20):
        d = genetics.read_genotypes(spark, str(tmp_path / "chr@"), part_bytes=part_bytes)
        assert {r.SNP: r.genotypes for r in d.collect()} == want
    one = genetics.read_packed(spark, str(tmp_path / "chr3"), 4)
    assert one.count() == 8 and {r.SNP: r.n for r in bands.with_counts(one).collect()} == {f"c3s{i}": int((row >= 0).sum()) for i, row in enumerate(per[3])}
    raw = (tmp_path / "chr3.bed").read_bytes()
    (tmp_path / "chr3.bed").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="doesn't fit the number of people"):
        genetics.read_packed(spark, str(tmp_path / "chr3")).count()
    (tmp_path / "chr3.bed").write_bytes(b"\x6c\x1b\x00" + raw[3:])
    with pytest.raises(Exception, match="no SNP-major genotype file"):
        genetics.read_packed(spark, str(tmp_path / "chr3")).count()


def test_a_genotype_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file: 2.2 GB of length, next to nothing on the disk; the last SNPs alone are looked at."""
    people, snps = 4_400_000, 2000
    width = people // 4
    with open(tmp_path / "big.bed", "wb") as f:
        f.write(b"\x6c\x1b\x01")
        f.truncate(3 + width * snps)
        f.seek(3 + width * (snps - 1))
        f.write(b"\xe4" * width)  # codes 0, 1, 2, 3
    reader = genetics.BedReader({"path": str(tmp_path / "big.bed"), "people": str(people), "part_bytes": str(64 << 20)})
    parts = reader.partitions()
    assert sum(p.count for p in parts) == snps and len(parts) > 30 and 3 + width * snps > 2**31
    last = list(reader.read(genetics.Snps(parts[-1].path, snps - 1, 1, 0)))
    g = bands.unpack(last[0].column(1).to_pylist(), people)
    assert g.shape == (1, people) and (g[0, :4] == [2, 3, 1, 0]).all()


def test_people_that_differ_are_an_error(spark):
    d = spark.createDataFrame([("1", 1, "a", [0, 1]), ("1", 2, "b", [0, 1, 2])], "CHR string, BP long, SNP string, genotypes array<int>")
    with pytest.raises(Exception, match="different numbers of people"):
        bands.ld_matrix(d, 10).collect()
    assert issubclass(FormatError, ValueError)
