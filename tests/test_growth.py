"""Steps whose memory or time must not grow faster than their input."""

import numpy as np
import pyarrow as pa
import pytest

from quillon.plans import catalog
from quillon.sources import bam, blocks, formats, tabix


def test_distinct_counts_stand_apart_from_sketches(spark, tmp_path):
    rows = [("a", i, float(i)) for i in range(40)] + [("a", None, None), (None, 1, 2.0), (None, 1, 3.0), ("b", None, None)]
    spark.createDataFrame(rows, "event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.approx_distinct(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("a", 40, 40, True, True), (None, 1, 2, True, True), ("b", 0, 0, True, True)}
    sketches = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "approx_count_distinct" in x and "Aggregate [" in x]
    assert sketches and not any("user_id" in x.split("Aggregate [")[1].split("]")[0] for x in sketches)  # a sketch a type, none a user


def _reads(n):
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    rows = [(f"r{i}", 4, "s1", i, 30, f"{i % 90 + 1}M2I" if i % 3 else None, "=", 7, -3, "acGT=" * (i % 5) + "éR", "*" if i % 2 else "I" * (5 * (i % 5) + 2)) for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in bam.READS.split(", ")])


def test_bam_records_are_made_by_columns():
    batch = _reads(500)
    data = bam.encode(batch, {"s1": 0})
    raw = np.frombuffer(data, np.uint8)
    at, k = [], 0
    while k < len(data):
        at.append(k)
        k += 4 + int(np.frombuffer(data[k : k + 4], "<i4")[0])
    back = bam.decode(raw, np.array(at), ["s1"])
    want = [r | {"cigar": r["cigar"] or "*", "seq": r["seq"].upper().replace("É", "N")} for r in batch.to_pylist()]
    assert back.to_pylist() == want
    assert bam.encode(batch.slice(0, 0), {}) == b""
    with pytest.raises(blocks.FormatError, match="quality of another length"):
        bam.encode(pa.RecordBatch.from_pylist([batch.to_pylist()[0] | {"qual": "I"}], batch.schema), {"s1": 0})


def test_bam_search_for_the_first_record_looks_at_few_places(monkeypatch):
    raw, seen = np.frombuffer(bam.encode(_reads(5000), {"s1": 0}), np.uint8)[11:], []
    plausible = bam._plausible
    monkeypatch.setattr(bam, "_plausible", lambda r, at, n: seen.append(len(at)) or plausible(r, at, n))
    first = 4 + int(np.frombuffer(bam.encode(_reads(1), {"s1": 0})[:4], "<i4")[0]) - 11
    assert bam.resync(raw, len(raw), 1, False) == first
    assert sum(seen) < len(raw) / 4


def test_sorted_lines_take_files_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tabix, "FILE_LINES", 100)
    rows = spark.range(3000).selectExpr("'c' AS chrom", "CAST(7 AS BIGINT) AS pos", "concat('c\t7\t', id) AS value")
    out = tabix.sorted_lines(rows)
    sizes = [len(x) for x in out.rdd.glom().collect()]
    assert len(sizes) == 30 and sum(sizes) == 3000 and max(sizes) < 400  # also where all are of one position


def test_fastq_records_are_made_where_they_start(spark, tmp_path):
    p = tmp_path / "reads"
    p.mkdir()
    reads = [(f"r{i}", "" if i % 7 == 0 else "ACGT"[i % 4] * (i % 23 + 1)) for i in range(400)]
    for k in range(2):
        (p / f"{k}.fastq").write_text("".join(f"@{n} d{k}\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads) + "\n" * k)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, rows in ((700, 3), (5000, 10), (40, 10)):  # splits that hold several records, and such as hold less than one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            if size == 40:
                (p / "0.fastq").write_text("".join(f"@{n} d0\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads[:40]))
                (p / "1.fastq").unlink()
            got = formats.read_fastq(spark, str(p))
            want = [(n, f"d{k}", s, "@" * len(s)) for k in range(2 if size > 40 else 1) for n, s in (reads if size > 40 else reads[:40])]
            assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "MapInArrow" in plan  # lines are neither sorted nor dealt out
