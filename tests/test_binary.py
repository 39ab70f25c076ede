"""Binary and block-compressed formats: files written here or by the package, read back whole and by ranges."""

import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.sources import bam, blocks, formats


def reads(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        m = rng.choice([0, 1, 7, 40, 151])
        seq = "".join(rng.choice("ACGTN") for _ in range(m)) or "*"
        qual = "*" if m == 0 or rng.random() < 0.2 else "".join(chr(33 + rng.randrange(60)) for _ in range(m))
        ref = rng.choice(["chr1", "chr2", "*"])
        cigar = rng.choice(["*", f"{m}M", f"3S{max(1, m)}M2I1D4H"])
        rows.append((f"r{i}/{'x' * rng.randrange(30)}", rng.randrange(4096), ref, 0 if ref == "*" else rng.randrange(1, 10**8), rng.randrange(256), cigar, rng.choice(["=", "*", "chr2"]) if ref != "*" else "*", rng.randrange(1000), rng.randrange(-500, 500), seq, qual))
    return rows


def as_sam(r):
    """rnext of a mate on the same reference is =."""
    r = list(r)
    if r[6] == r[2] and r[2] != "*":
        r[6] = "="
    return tuple(r)


def one_bam(path, rows, block=3000):
    """A BAM file with small blocks, so that ranges cut records and blocks."""
    names = ["chr1", "chr2"]
    batch = bam.pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in bam.READS.split(", ")], r, strict=True)) for r in rows])
    text = b"@HD\tVN:1.6\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**9) for n in names)
    data += bam.encode(batch, {n: k for k, n in enumerate(names)}) if rows else b""
    out = b"".join(blocks.bgzf_compress(data[k : k + block]) for k in range(0, len(data), block)) + blocks.BGZF_END
    path.write_bytes(out)
    return str(path)


def test_bam_equals_the_sam_text_for_any_ranges(spark, tmp_path):
    rows = reads(3000)
    path = one_bam(tmp_path / "a.bam", rows)
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1.6\n" + "".join("\t".join(map(str, as_sam(r))) + "\n" for r in rows))
    want = sorted(tuple(r) for r in formats.read(spark, str(sam)).collect())
    size = os.path.getsize(path)
    for parts in (1, 4, 16, 301):
        got = bam.read_bam(spark, path, -(-size // parts))
        assert got.rdd.getNumPartitions() >= parts - 1
        assert sorted(tuple(r) for r in got.collect()) == want
    assert formats.read(spark, path).count() == 3000


def test_bam_cases(spark, tmp_path):
    assert bam.read_bam(spark, one_bam(tmp_path / "none.bam", [])).count() == 0
    path = tmp_path / "cut.bam"
    whole = one_bam(path, reads(200))
    raw = open(whole, "rb").read()
    for cut, what in ((len(raw) // 2, "ends within"), (len(raw) - 40, "")):
        path.write_bytes(raw[:cut])
        with pytest.raises(Exception, match=f"FormatError.*{what}|{what}.*"):
            bam.read_bam(spark, str(path)).count()
    path.write_bytes(b"no bam at all")
    with pytest.raises(Exception, match="does not start with a bgzf block"):
        bam.read_bam(spark, str(path)).count()
    path.write_bytes(blocks.bgzf_compress(b"other"))
    with pytest.raises(Exception, match="no BAM file|cut off"):
        bam.read_bam(spark, str(path)).count()


def test_bam_is_written_by_tasks_and_read_back(spark, tmp_path):
    rows = reads(500, 7)
    df = spark.createDataFrame(rows, bam.READS).repartition(5)
    bam.write_bam(df, str(tmp_path / "out"), ["chr1", "chr2"])
    assert len(os.listdir(tmp_path / "out")) == 5
    assert sorted(map(tuple, bam.read_bam(spark, str(tmp_path / "out"), 5000).collect())) == sorted(map(as_sam, rows))


def test_block_text_by_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = ["".join(rng.choice("abcé\t ") for _ in range(rng.choice([0, 1, 50, 5000]))) for _ in range(400)]
    data = "\n".join(rows).encode()
    (tmp_path / "a.gz").write_bytes(b"".join(blocks.bgzf_compress(data[k : k + 777]) for k in range(0, len(data), 777)) + blocks.BGZF_END)
    import zstandard

    frames = [data[k : k + 50_000] for k in range(0, len(data), 50_000)]
    (tmp_path / "a.tsv.zst").write_bytes(b"".join(zstandard.ZstdCompressor(write_checksum=i % 2 == 0).compress(x) for i, x in enumerate(frames)))
    for name, codec in (("a.gz", "bgzf"), ("a.tsv.zst", "zstd")):
        size = os.path.getsize(tmp_path / name)
        for parts in (1, 3, 50):
            df = blocks.read_block_text(spark, str(tmp_path / name), codec, -(-size // parts))
            assert sorted(r[0] for r in df.collect()) == sorted(rows)
    busy = blocks.read_block_text(spark, str(tmp_path / "a.tsv.zst"), "zstd", 1000).groupBy(F.spark_partition_id()).count().count()
    assert len(frames) > 10 and busy > 3
    (tmp_path / "bad.gz").write_bytes(zlib.compress(b"x"))
    with pytest.raises(Exception, match="does not start with a bgzf block"):
        blocks.read_block_text(spark, str(tmp_path / "bad.gz")).count()


def test_fastq_keeps_empty_reads_and_refuses_other_lines(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text("@r1 d\nAC\n+\nII\n@r2\n\n+\n\n@r3\nG\n+r3\n@\n@r4\n\n+\n\n\n\n")
    got = sorted(map(tuple, formats.read(spark, str(p)).collect()))
    assert got == [("r1", "d", "AC", "II"), ("r2", "", "", ""), ("r3", "", "G", "@"), ("r4", "", "", "")]
    for bad in ("@r1\nAC\n+\nI\n", "r1\nAC\n+\nII\n", "@r1\nAC\nII\n", "@r1\nAC\n+\nII\n@r2\nA\n", "\n@r1\nAC\n+\nII\n"):
        p.write_text(bad)
        with pytest.raises(Exception, match="is no FASTQ record"):
            formats.read(spark, str(p)).collect()


VCF = """##fileformat=VCFv4.1
##INFO=<ID=AF,Number=A,Type=Float,Description="frequency, by allele">
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">
##INFO=<ID=DB,Number=0,Type=Flag,Description="in a data base">
##INFO=<ID=A.F,Number=.,Type=String,Description="a key with a dot">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depth by allele">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
1\t10\trs1\tA\tC,G\t5.5\tPASS\tAF=0.5,.;AF=0.6;DB;DP=7\tGT:AD\t0/1:3,4,.\t.:.
1\t20\t.\tAT\tC\t.\tq10;s50\tDP=x;A.F=u,v;AXF=w\tGT\t1/1\t0/0
X\t5\t.\tA\t.\t.\t.\t.\tAD:GT\t1,2:0|1\t.
"""


def test_vcf_has_the_header_s_types(spark, tmp_path):
    for name in ("a.vcf", "b.vcf.gz"):
        (tmp_path / name).write_bytes(VCF.encode() if name == "a.vcf" else b"".join(blocks.bgzf_compress(VCF.encode()[k : k + 100]) for k in range(0, len(VCF), 100)) + blocks.BGZF_END)
        df = formats.read(spark, str(tmp_path / name))
        kinds = {f.name: f.dataType.simpleString() for f in df.schema["info"].dataType} | {f.name: f.dataType.simpleString() for f in df.schema["S1"].dataType}
        assert kinds == {"AF": "array<double>", "DP": "int", "DB": "boolean", "A.F": "array<string>", "GT": "string", "AD": "array<int>"}
        a, b, c = df.orderBy("chrom", "pos").collect()
        assert a.info.asDict() == {"AF": [0.5, None], "DP": 7, "DB": True, "A.F": None} and a.S1.asDict() == {"GT": "0/1", "AD": [3, 4, None]} and a.S2.asDict() == {"GT": None, "AD": None}
        assert b.info.asDict() == {"AF": None, "DP": None, "DB": False, "A.F": ["u", "v"]} and b["filter"] == ["q10", "s50"] and b.S1.AD is None
        assert c.alt is None and c.info.DB is False and c.S1.asDict() == {"GT": "0|1", "AD": [1, 2]}
    plan = formats.read(spark, str(tmp_path / "a.vcf")).select("chrom")._jdf.queryExecution().executedPlan().toString()
    assert "AF" not in plan and "regexp" not in plan
    plan = formats.read(spark, str(tmp_path / "a.vcf")).select("info.AF")._jdf.queryExecution().optimizedPlan().toString()
    assert "DP" not in plan
    (tmp_path / "plain.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t1\t.\tA\tC\t.\t.\tAF=0.5;AF=0.6;DB\n")
    assert formats.read(spark, str(tmp_path / "plain.vcf")).first().info == {"AF": "0.5", "DB": None}


def test_cram_is_a_named_error(spark):
    with pytest.raises(formats.UnsupportedFormat, match="CRAM"):
        formats.read(spark, "/nowhere/a.cram")


def test_bins():
    from quillon.sources import tabix

    assert tabix.bins(0, 1)[:3] == [0, 1, 9] and tabix.bin_of(0, 1) == 4681 and tabix.bin_of(0, 1 << 29) == 0
    rng = random.Random(1)
    for _ in range(500):
        a = rng.randrange(1 << 20)
        b = a + rng.randrange(1, 1 << rng.randrange(1, 20))
        c = rng.randrange(1 << 20)
        d = c + rng.randrange(1, 1 << 18)
        if a < d and c < b:
            assert tabix.bin_of(a, b) in tabix.bins(c, d)
    assert tabix.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000) and tabix.parse_region("HLA:01:5") == ("HLA:01", 5, None) and tabix.parse_region("X") == ("X", 1, None)
    assert tabix.parse_region("1:[0,10)") == ("1", 1, 10)
    with pytest.raises(ValueError, match="no region"):
        tabix.parse_region("1:9-3")


def test_vcf_regions_read_their_blocks_only(spark, tmp_path):
    from quillon.sources import tabix

    rng = random.Random(5)
    rows, pos = [], 0
    for c in ("1", "2", "X"):
        pos = 0
        for _ in range(4000):
            pos += rng.choice([0, 1, 50, 3000])
            ref = "A" * rng.choice([1, 1, 1, 40, 30_000 if rng.random() < 0.002 else 2])
            rows.append((c, max(1, pos), f"{c}\t{max(1, pos)}\t.\t{ref}\tC\t.\tPASS\tDP={rng.randrange(100)}" + (f";END={max(1, pos) + 20_000}" if rng.random() < 0.001 else "")))
    head = '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO'
    df = spark.createDataFrame(rows, "chrom string, pos long, value string")
    tabix.write_indexed_vcf(tabix.sorted_lines(df, parts=3), str(tmp_path / "v"), head)
    assert len([n for n in os.listdir(tmp_path / "v") if n.endswith(".gz")]) == 3
    whole = [(c, p, len(v.split("\t")[3]), int(v.split("DP=")[1].split(";")[0]), int(v.split("END=")[1]) if "END=" in v else p + len(v.split("\t")[3]) - 1) for c, p, v in rows]
    for region in ("1", "2:1-1", "X:500000", "2:40000-90000", "1:[100000,100001)", "2:1,000,000-1,050,000", "nowhere:1-10", "X:999999999-1000000000"):
        c, a, b = tabix.parse_region(region)
        want = sorted((x, p, n, d) for x, p, n, d, e in whole if x == c and p <= (b or 1 << 60) and max(p, e) >= a)
        got = sorted((r.chrom, r.pos, len(r.ref), r.info.DP) for r in tabix.read_vcf_region(spark, str(tmp_path / "v"), region).collect())
        assert got == want
    file = str(tmp_path / "v" / "part-00000.vcf.gz")
    index = tabix.read_index(file)
    (begin, end), *_ = index.chunks("1", 1_000_000, 1_010_000)
    f = blocks.ByteFile(file)
    assert (end >> 16) - (begin >> 16) < f.size / 10
    assert formats.read(spark, file).count() == sum(r.chrom is not None for r in formats.read(spark, file).select("chrom").collect())
    os.rename(file + ".tbi", file + ".away")
    with pytest.raises(tabix.NoIndex, match="no .tbi or .csi"):
        tabix.read_vcf_region(spark, file, "1:1-10")


def test_csi_index(spark, tmp_path):
    from quillon.sources import tabix

    text = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    lines_ = [f"c\t{p}\t.\tA\tC\t.\t.\t." for p in range(1, 200_000, 500)]
    data, at, places = b"", 0, {}
    for k in range(0, len(lines_), 40):
        part = (text.encode() if k == 0 else b"") + "".join(x + "\n" for x in lines_[k : k + 40]).encode()
        raw = blocks.bgzf_compress(part)
        for x in lines_[k : k + 40]:
            places.setdefault(tabix.bin_of(int(x.split("\t")[1]) - 1, int(x.split("\t")[1])), []).append(((at << 16) | part.index(x.encode() + b"\n"), (at + len(raw)) << 16))
        data, at = data + raw, at + len(raw)
    (tmp_path / "c.vcf.gz").write_bytes(data + blocks.BGZF_END)
    aux = struct.pack("<7i", 2, 1, 2, 0, 35, 0, 2) + b"c\0"
    body = b"CSI\x01" + struct.pack("<3i", 14, 5, len(aux)) + aux + struct.pack("<ii", 1, len(places))
    for b, c in places.items():
        body += struct.pack("<IQi2Q", b, c[0][0], 1, c[0][0], c[-1][1])
    (tmp_path / "c.vcf.gz.csi").write_bytes(blocks.bgzf_compress(body) + blocks.BGZF_END)
    got = sorted(r.pos for r in tabix.read_vcf_region(spark, str(tmp_path / "c.vcf.gz"), "c:50000-60000").collect())
    assert got == [p for p in range(1, 200_000, 500) if 50_000 <= p <= 60_000]
    (tmp_path / "c.vcf.gz.csi").write_bytes(blocks.bgzf_compress(body[:-9]))
    with pytest.raises(blocks.FormatError, match="cut off"):
        tabix.read_vcf_region(spark, str(tmp_path / "c.vcf.gz"), "c")


def big_file(path, rows, wig, order, packed=True, kinds=(1,), per=40):
    """A BigWig (rows chrom, start, end, value) or BigBed file with data blocks of some rows and an R-tree of two levels."""
    u = lambda k, *v: struct.pack(order + k, *v)
    names = sorted({r[0] for r in rows})
    number = {n: k for k, n in enumerate(names)}
    key = max(map(len, names), default=1)
    tree = u("IIIIQQ", 0x78CA8C91, 8, key, 8, len(names), 0)
    half = names[: len(names) // 2], names[len(names) // 2 :]
    chrom_at = 64
    node = lambda part: u("BBH", 1, 0, len(part)) + b"".join(n.encode().ljust(key, b"\0") + u("II", number[n], 10**9) for n in part)
    root = u("BBH", 0, 0, 2)
    at = chrom_at + len(tree) + 4 + 2 * (key + 8)
    leaves = b""
    for part in half:
        root += (part[0] if part else names[0] if names else "").encode().ljust(key, b"\0") + u("Q", at + len(leaves))
        leaves += node(part)
    body = tree + root + leaves
    data_at = chrom_at + len(body)
    out, index, k = b"", [], 0
    for n in names:
        own = [r for r in rows if r[0] == n]
        for a in range(0, len(own), per):
            part, kind = own[a : a + per], kinds[k % len(kinds)]
            k += 1
            if not wig:
                raw = b"".join(u("III", number[n], r[1], r[2]) + b"name\t7\0" for r in part)
            else:
                span, step = part[0][2] - part[0][1], part[1][1] - part[0][1] if len(part) > 1 else 1
                raw = u("IIIIIBBH", number[n], part[0][1], part[-1][2], step, span, kind, 0, len(part))
                for r in part:
                    raw += u("IIf", *r[1:]) if kind == 1 else u("If", r[1], r[3]) if kind == 2 else u("f", r[3])
            raw = zlib.compress(raw) if packed else raw
            index.append((number[n], part[0][1], number[n], part[-1][2], data_at + len(out), len(raw)))
            out += raw
    index_at = data_at + len(out)
    tree = u("IIQIIIIQII", 0x2468ACE0, 16, len(index), 0, 0, len(names), 10**9, index_at, 1, 0)
    groups = [index[a : a + 5] for a in range(0, len(index), 5)]
    top = u("BBH", 0, 0, len(groups))
    at = index_at + 48 + 4 + 24 * len(groups)
    low = b""
    for g in groups:
        top += u("IIIIQ", *g[0][:2], *g[-1][2:4], at + len(low))
        low += u("BBH", 1, 0, len(g)) + b"".join(u("IIIIQQ", *x) for x in g)
    head = u("IHHQQQHHQQIQ", 0x888FFC26 if wig else 0x8789F2EB, 4, 0, chrom_at, data_at, index_at, 0 if wig else 3, 0 if wig else 3, 0, 0, 32768 if packed else 0, 0)
    path.write_bytes(head.ljust(64, b"\0") + body + out + tree + top + low)


@pytest.mark.parametrize(("order", "packed"), [("<", True), (">", True), ("<", False)])
def test_bigwig_and_bigbed(spark, tmp_path, order, packed):
    from quillon.sources import bigbin

    rows = [(c, 10 * k, 10 * k + 4, float(k % 7) / 4) for c in ("chr1", "chr2", "chrX") for k in range(700)]
    big_file(tmp_path / "a.bw", rows, True, order, packed, kinds=(1, 2, 3))
    big_file(tmp_path / "a.bb", rows, False, order, packed)
    for part_bytes in (1, 1000, 1 << 20):
        assert sorted(map(tuple, bigbin.read_bigwig(spark, str(tmp_path / "a.bw"), part_bytes=part_bytes).collect())) == rows
        assert sorted(map(tuple, bigbin.read_bigbed(spark, str(tmp_path / "a.bb"), part_bytes=part_bytes).collect())) == [r[:3] for r in rows]
    assert formats.read(spark, str(tmp_path / "a.bw")).count() == formats.read(spark, str(tmp_path / "a.bb")).count() == 2100
    want = [r for r in rows if r[0] == "chr2" and r[2] > 1003 and r[1] < 2001]
    assert sorted(map(tuple, bigbin.read_bigwig(spark, str(tmp_path / "a.bw"), chrom="chr2", start=1003, end=2001).collect())) == want
    big = bigbin.BigFile(str(tmp_path / "a.bw"))
    assert len(big.leaves("chr2", 1003, 2001)) <= 4 < len(big.leaves()) and big.leaves("chr9") == []
    assert bigbin.read_bigwig(spark, str(tmp_path / "a.bw"), chrom="chr9").count() == 0
    raw = (tmp_path / "a.bw").read_bytes()
    (tmp_path / "a.bw").write_bytes(b"abcd" + raw[4:])
    with pytest.raises(Exception, match="neither BigWig nor BigBed"):
        bigbin.read_bigwig(spark, str(tmp_path / "a.bw")).count()


BCF_HEAD = VCF.split("#CHROM")[0].replace("##fileformat=VCFv4.1\n", '##fileformat=VCFv4.1\n##contig=<ID=1>\n##contig=<ID=X>\n##FILTER=<ID=q10,Description="x">\n##FILTER=<ID=s50,Description="x">\n')


def bcf_bytes(lines_, samples=("S1", "S2")):
    """BCF records of VCF lines; integers in the smallest type that holds them."""
    from quillon.sources import bcf

    head = BCF_HEAD + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples) + "\n"
    strings, contigs = bcf.dictionaries(head)
    number = {v: k for k, v in strings.items()}
    kinds = {m[2]: m[3] for m in __import__("re").finditer(r"##(INFO|FORMAT)=<ID=([^,]+),Number=[^,]+,Type=(\w+)", head)}

    def kind(code, n):
        return bytes([n << 4 | code]) if n < 15 else bytes([15 << 4 | code]) + ints([n])

    def ints(v, width=None, head=True):
        some = [x for x in v if x is not None]
        code = next(c for c in (1, 2, 3) if all(-(2 ** (8 * 2 ** (c - 1) - 1)) + 8 <= x < 2 ** (8 * 2 ** (c - 1) - 1) for x in some))
        letter, _, missing, end = bcf.INTEGERS[code]
        v = [missing if x is None else x for x in v] + [end] * ((width or len(v)) - len(v))
        return (kind(code, len(v)) if head else b"") + struct.pack(f"<{len(v)}{letter}", *v)

    def floats(v):
        return kind(5, len(v)) + b"".join(struct.pack("<I", bcf.FLOAT_MISSING) if x is None else struct.pack("<f", x) for x in v)

    text = lambda s: kind(7, len(s.encode())) + s.encode()
    split = lambda s, conv: [None if x == "." else conv(x) for x in s.split(",")]
    out = []
    for li in lines_:
        c, p, i, ref, alt, q, flt, info, fmt, *cells = li.split("\t")
        alleles = [ref, *([] if alt == "." else alt.split(","))]
        pairs = [] if info == "." else [x.split("=", 1) for x in info.split(";")]
        keys = fmt.split(":")
        shared = struct.pack("<iiiIHHI", {v: k for k, v in contigs.items()}[c], int(p) - 1, len(ref), bcf.FLOAT_MISSING if q == "." else struct.unpack("<I", struct.pack("<f", float(q)))[0], len(pairs), len(alleles), len(keys) << 24 | len(cells))
        shared += text("" if i == "." else i) + b"".join(map(text, alleles)) + (ints([number[x] for x in flt.split(";")]) if flt != "." else b"\0")
        for k, *v in pairs:
            shared += ints([number[k]]) + (b"\0" if not v else floats(split(v[0], float)) if kinds[k] == "Float" else ints(split(v[0], int)) if kinds[k] == "Integer" else text(v[0]))
        own = b""
        table = [(x.split(":") + ["."] * 9)[: len(keys)] for x in cells]
        for k, key in enumerate(keys):
            own += ints([number[key]])
            col = [row[k] for row in table]
            if key == "GT":
                al = [[0 if a == "." else (int(a) + 1 << 1) | ("|" in g and j > 0) for j, a in enumerate(g.replace("|", "/").split("/"))] for g in col]
                w = max(map(len, al))
                own += kind(1, w) + b"".join(ints(a, w, head=False) for a in al)
            else:
                v = [split(x, int) for x in col]
                w = max(map(len, v))
                letter, _, missing, end = bcf.INTEGERS[2]
                own += kind(2, w) + b"".join(struct.pack(f"<{w}{letter}", *[missing if x is None else x for x in r], *[end] * (w - len(r))) for r in v)
        out.append(struct.pack("<II", len(shared), len(own)) + shared + own)
    raw = head.encode() + b"\0"
    return b"BCF\x02\x02" + struct.pack("<I", len(raw)) + raw + b"".join(out)


def test_bcf_equals_vcf(spark, tmp_path):
    rng = random.Random(4)
    rows = [x for x in VCF.split("\n") if x and not x.startswith("#")]
    rows[1] = rows[1].replace("DP=x;", "DP=70000;").replace(";AXF=w", "")
    rows = [r.replace("AF=0.6;", "") for r in rows]
    for k in range(2000):
        info = ";".join(x for x in (f"AF={rng.randrange(8) / 8},.", f"DP={rng.choice([3, 300, 70000, -5])}", "DB") if rng.random() < 0.7) or "."
        rows.append(f"{rng.choice('1X')}\t{k + 1}\t{rng.choice(['.', f'rs{k}', 'long' * 9])}\t{'A' * rng.choice([1, 20])}\tC,G\t{rng.choice(['.', '7', '2.5'])}\t{rng.choice(['PASS', '.', 'q10;s50'])}\t{info}\tGT:AD\t{rng.choice(['0/1', '1|0', './.', '1'])}:{rng.choice(['1,2,3', '.', '4,.'])}\t0/0:9")
    data = bcf_bytes(rows)
    (tmp_path / "a.bcf").write_bytes(b"".join(blocks.bgzf_compress(data[k : k + 1500]) for k in range(0, len(data), 1500)) + blocks.BGZF_END)
    (tmp_path / "a.vcf").write_text(BCF_HEAD + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n" + "\n".join(rows) + "\n")
    from quillon.sources import bcf

    vcf = formats.read(spark, str(tmp_path / "a.vcf"))
    key = lambda r: str(r)
    want = sorted(vcf.collect(), key=key)
    size = os.path.getsize(tmp_path / "a.bcf")
    for parts in (1, 4, 40):
        d = bcf.read_bcf(spark, str(tmp_path / "a.bcf"), -(-size // parts))
        assert d.schema == vcf.schema and sorted(d.collect(), key=key) == want
    (tmp_path / "a.bcf").write_bytes((tmp_path / "a.bcf").read_bytes()[: size // 2])
    with pytest.raises(Exception, match="FormatError"):
        bcf.read_bcf(spark, str(tmp_path / "a.bcf")).count()
