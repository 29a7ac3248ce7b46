"""Formats: byte-level round trips, damaged files, indexes, probes."""

import gzip
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from readloom.errors import ReadloomError
from readloom.functions import kernels as K
from readloom.sources import bam, bgzf, fastq, files, header, index, probe, sam

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chrA\tLN:5000
@SQ\tSN:chrB\tLN:700
@RG\tID:g1\tSM:s1\tXX:more
@PG\tID:align\tPN:tool
@CO\ta note
r1\t99\tchrA\t11\t60\t4M1I3M\t=\t101\t98\tACGTNACG\tIIIIHHHH\tNM:i:1\tRG:Z:g1\tZB:B:c,1,-2
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\tXA:A:q\tXF:f:1.5
r3\t16\tchrB\t700\t7\t3M\tchrA\t5\t0\tTTT\t!!!\tNM:i:300
"""


@pytest.fixture()
def tiny(spark, tmp_path):
    path = str(tmp_path / "tiny.sam")
    open(path, "w").write(SAM)
    bam.register(spark)
    fastq.register(spark)
    return path


def write(spark, reads, head, path):
    return bam.write_bam(reads.coalesce(1).sortWithinPartitions("ordinal"), head, path, "file://" + path + ".parts")


def many(spark, tiny, n):
    """Many records that straddle blocks."""
    reads = sam.read_sam(spark, tiny).where("ordinal = 0")
    rows = reads.crossJoin(spark.range(n)).withColumn("ordinal", F.col("id")).withColumn("read_name", F.concat(F.lit("read"), F.sha2(F.col("id").cast("string"), 256)))
    return rows.drop("id").withColumn("block_size", F.lit(0))


def test_sam_to_bam_and_back(spark, tiny, tmp_path):
    reads, head = sam.read_sam(spark, tiny), sam.read_header(tiny)
    assert head.text() == "".join(line + "\n" for line in SAM.splitlines() if line.startswith("@"))
    path = str(tmp_path / "tiny.bam")
    assert write(spark, reads, head, path) == 3
    again = spark.read.format("bam").load(path)
    strip = lambda df: sorted((tuple(r)[1:] for r in df.collect()), key=lambda r: r[0])
    assert strip(again) == strip(reads)
    assert bam.read_header(path).text() == head.text() and bam.read_header(path).references == [("chrA", 5000), ("chrB", 700)]
    assert probe.probe(path) == probe.Probe("BAM", "bgzf", "high") and probe.verify(path).format == "BAM"
    probe.check_eof(path)
    text = {r.read_name: r for r in bam.decoded(again).collect()}
    assert text["r1"].sequence == "ACGTNACG" and text["r1"].quality == "IIIIHHHH" and text["r1"].rg == "g1" and text["r1"].tags == ["NM", "RG", "ZB"]
    assert text["r2"].quality == "*" and text["r2"].ref_id == -1 and text["r1"].next_ref_id == 0 and text["r3"].next_ref_id == 0
    assert bam.numbers(text["r1"].cigar) == [(4, "M"), (1, "I"), (3, "M")]
    with pytest.raises(ReadloomError, match="output_exists"):
        write(spark, reads, head, path)


def test_ranges_that_straddle_blocks(spark, tiny, tmp_path):
    path = str(tmp_path / "many.bam")
    rows = many(spark, tiny, 5000)
    assert bam.write_bam(rows.orderBy("ordinal"), sam.read_header(tiny), path, f"file://{tmp_path}/parts") == 5000
    plan = bam.plan_ranges(path, 30_000)
    assert len(plan) > 3 and sum(r.records for r in plan) == 5000
    back = spark.read.format("bam").option("rangeBytes", 30_000).load(path)
    assert back.rdd.getNumPartitions() == len(plan)
    want = {r.ordinal: r.read_name for r in rows.select("ordinal", "read_name").collect()}
    assert {r.ordinal: r.read_name for r in back.select("ordinal", "read_name").collect()} == want
    assert spark.read.format("bam").option("rangeBytes", 30_000).option("maxRecords", 1234).load(path).count() == 1234
    first = bam.checksum(back, canonical=True)
    assert first == bam.checksum(back.orderBy("read_name"), canonical=True)
    moved = back.withColumn("ordinal", 4999 - F.col("ordinal"))
    assert bam.checksum(moved, True) == first and bam.checksum(moved, False) != bam.checksum(back, False)
    assert bam.checksum(back, True, ("NM",)) != first


def test_plans_made_by_tasks(spark, tiny, tmp_path):
    path = str(tmp_path / "a.bam")
    head = sam.read_header(tiny)
    rng = random.Random(3)
    rows = [r.asDict() for r in sam.read_sam(spark, tiny).orderBy("ordinal").collect()]
    long = rows[0] | {"aux_bytes": b"XZZ" + bytes(rng.randrange(65, 91) for _ in range(400000)) + b"\0"}  # a record over several blocks
    body = b"".join(bam.encode_record(long if i % 700 == 650 else rows[i % len(rows)] | {"read_name": f"n{i}-{rng.random()}"}) for i in range(2000))
    data = bgzf.deflate(head.binary()) + bgzf.deflate(body) + bgzf.EOF_MARKER
    open(path, "wb").write(data)
    want = spark.read.format("bam").load(path).orderBy("ordinal").collect()
    assert len(want) == 2000
    for size in (3000, 70000, 200000):
        ranges, damage = bam.plan_bam(spark, path, size)
        assert damage is None and sum(r.records for r in ranges) == 2000
        # the same places as from the sequential pass, up to where ranges are cut
        assert bam.read_bam(spark, path, size).orderBy("ordinal").collect() == want
    open(path, "wb").write(data[: len(data) // 2])
    ranges, damage = bam.plan_bam(spark, path, 70000)
    assert damage == bam.scan_plan(path)[1] and damage[0] == "truncated_record" and sum(r.records for r in ranges) == damage[1] - 1
    with pytest.raises(ReadloomError, match="truncated_file"):
        bam.read_bam(spark, path, 70000)
    offsets, at = [], 0
    while at < len(body):
        offsets.append(at)
        at += 4 + int.from_bytes(body[at : at + 4], "little")
    bad = body[: offsets[1500]] + b"\x05\0\0\0" + body[offsets[1500] :]
    open(path, "wb").write(bgzf.deflate(head.binary()) + bgzf.deflate(bad) + bgzf.EOF_MARKER)
    assert bam.plan_bam(spark, path, 70000)[1] == bam.scan_plan(path)[1] == ("invalid_record", 1501, "a block size of 5")


def test_damaged_files(spark, tiny, tmp_path):
    path, cut = str(tmp_path / "a.bam"), str(tmp_path / "cut.bam")
    write(spark, sam.read_sam(spark, tiny), sam.read_header(tiny), path)
    data = open(path, "rb").read()
    open(cut, "wb").write(data[:-28])
    with pytest.raises(ReadloomError, match="truncated_file"):
        probe.check_eof(cut)
    assert len(bam.plan_ranges(cut)) == 1
    body = b"".join(bgzf.inflate(data[a : a + n]) for a, n in [(0, bgzf.member_size(data))])
    records = data[bgzf.member_size(data) :]
    inflated = bgzf.inflate(records[: bgzf.member_size(records)])
    open(cut, "wb").write(bgzf.deflate(body) + bgzf.deflate(inflated[:-5]) + bgzf.EOF_MARKER)
    with pytest.raises(ReadloomError, match="truncated_file"):
        bam.plan_ranges(cut)
    open(cut, "wb").write(data[:40])
    with pytest.raises(ReadloomError):
        bam.read_header(cut)
    for bad in ("r1\t0\tchrA\n", "r1\t0\tnowhere\t1\t0\t*\t*\t0\t0\tA\tI\n"):
        open(cut + ".sam", "w").write(SAM + bad)
        with pytest.raises(Exception, match="parse_error"):
            sam.read_sam(spark, cut + ".sam").collect()


def test_header_operations():
    head = header.Header.parse_text("".join(line + "\n" for line in SAM.splitlines() if line.startswith("@")))
    sorted_ = head.with_order("queryname", "queryname:lexicographical")
    assert sorted_.records("HD") == [{"VN": "1.6", "SO": "queryname", "SS": "queryname:lexicographical"}]
    assert header.Header().with_order("unsorted").lines == [("HD", [("SO", "unsorted")])]
    assert head.unmapped().references == [] and head.unmapped().records("HD")[0]["SO"] == "unsorted"
    done = header.reheader(head, add_rg=[{"ID": "g2"}], remove_rg=["g1"], sample="new", set_pg=[{"ID": "align", "VN": "2"}], comments=["c"])
    assert done.records("RG") == [{"ID": "g2", "SM": "new"}] and done.records("PG")[0] == {"ID": "align", "PN": "tool", "VN": "2"}
    assert done.lines[-1] == ("CO", "c")
    with pytest.raises(ReadloomError, match="header_mismatch"):
        header.reheader(head, replacement=header.Header.parse_text("@SQ\tSN:x\tLN:1\n"))
    with pytest.raises(ReadloomError, match="invalid_header"):
        header.Header.parse_text("no header\n")
    parsed, end = header.parse_binary(head.binary())
    assert parsed.text() == head.text() and end == len(head.binary())


def test_fastq_and_sidecar(spark, tiny, tmp_path):
    text = "".join(f"@q{i} x\nACGT\n+\nIIII\n" for i in range(3000))
    plain, zipped = str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz")
    open(plain, "w").write(text)
    open(zipped, "wb").write(gzip.compress(text[: len(text) // 2].encode()) + gzip.compress(text[len(text) // 2 :].encode()))
    for path in (plain, zipped):
        rows = spark.read.format("fastq").load(path)
        assert rows.count() == 3000 and rows.where("ordinal = 7").first().read_name == "q7"
        assert fastq.count_fastq(spark, path) == 3000
    assert probe.probe(plain).format == "FASTQ" and probe.probe(zipped).format == "FASTQ.GZ"
    summary, points = fastq.build_gzi(zipped)
    assert summary["total_records"] == 3000 and points[0] == (0, 0, 0) and points[-1][2] == 3000
    fastq.write_gzi(zipped + ".gzi", summary, points)
    assert fastq.read_gzi(zipped + ".gzi") == (summary, points)
    fastq.write_gzi(zipped + ".gzi", summary | {"total_records": 5, "compressed_size": 1}, points, force=True)
    assert fastq.count_fastq(spark, zipped) == 3000 and fastq.count_fastq(spark, zipped, compat=True) == 5
    out = str(tmp_path / "c.fastq.gz")
    fastq.write_fastq(spark.range(50).selectExpr("id AS ordinal", "concat('@r', id, '\n', 'AC\n+\nII\n') AS record"), out)
    assert [r[1] for r in fastq.records(out)] == [f"r{i}" for i in range(50)]
    for bad in ("@a\nAC\n+\nI\n", "@a\nAC\n", "a\nAC\n+\nII\n"):
        open(plain, "w").write(bad)
        with pytest.raises(ReadloomError):
            list(fastq.records(plain))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_plain_fastq(spark, tmp_path, end):
    path = str(tmp_path / "a.fastq")
    lines = [line for i in range(40) for line in (f"@q{i} {'x' * (i % 7)}", "ACGT" * (i % 5 + 1), "+" + "@" * (i % 3), "@+II" * (i % 5 + 1))]
    for text in (end.join(lines) + end, end.join(lines)):
        open(path, "w", newline="").write(text)
        want = [(i, *r) for i, r in enumerate(fastq.records(path))]
        for size in (1, 7, 33, 64, 500, 10**6):
            got = fastq.read_fastq(spark, path, size).orderBy("ordinal").collect() if size > 30 else None
            if got is None:  # every range alone, without a job
                cuts = [*range(0, len(text), size), len(text)]
                ranges = [fastq.FastqRange(path, a, z, text[:a].count("\n")) for a, z in zip(cuts, cuts[1:])]
                assert [(n, *r) for part in ranges for n, r in part.read()] == want
            else:
                assert [(r.ordinal, r.raw_header, r.read_name, r.sequence, r.plus_line, r.quality) for r in got] == want
    open(path, "w").write("@a\nAC\n+\nII\n" * 20 + "@b\nAC\n")
    with pytest.raises(Exception, match="truncated_file"):
        fastq.read_fastq(spark, path, 50).count()


def test_fasta_and_discovery(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    fa = str(tmp_path / "d" / "x.fa")
    open(fa, "w").write(">a\nACGT\nAC\n>b\nGG\n")
    open(tmp_path / "d" / "e" / "y.bed", "w").write("chr1\t1\t5\n")
    os.symlink(fa, tmp_path / "d" / "link.fa")
    assert fastq.count_fasta(spark, fa) == 2
    assert [f.format for f in files.discover([str(tmp_path / "d")])] == ["FASTA"]
    found = files.discover([str(tmp_path / "d")], recursive=True)
    assert files.format_counts(found) == {"BED": 1, "FASTA": 1}
    open(fa, "w").write("ACGT\n>a\n")
    with pytest.raises(ReadloomError):
        fastq.count_fasta(spark, fa)
    open(fa, "w").write("")
    assert probe.probe(fa).format == "FASTA"


def test_index_files(tmp_path):
    path = str(tmp_path / "a.bam")
    open(path, "wb").write(b"x")
    assert index.check_index(path, 2)["state"] == "absent"
    bai = b"BAI\1" + struct.pack("<i", 2)
    bai += struct.pack("<i", 2) + struct.pack("<IiQQ", 5, 1, 0, 9) + struct.pack("<IiQQQQ", 37450, 2, 0, 0, 17, 3) + struct.pack("<iQ", 1, 0)
    bai += struct.pack("<i", 0) + struct.pack("<i", 0) + struct.pack("<Q", 4)
    open(path + ".bai", "wb").write(bai)
    assert index.parse_bai(path + ".bai", 2) == ([(17, 3), None], 4)
    assert index.check_index(path, 2)["state"] == "plausible" and index.check_index(path, 3)["state"] == "mismatched_or_invalid"
    os.utime(path + ".bai", (1, 1))
    assert index.check_index(path, 2)["state"] == "stale"
    open(path + ".csi", "wb").write(gzip.compress(b"CSI\1" + struct.pack("<iii", 14, 5, 0)))
    assert index.check_index(path, 2, prefer_csi=True)["state"] == "detected_but_not_supported"
    with pytest.raises(ReadloomError, match="missing_index"):
        index.check_index(str(tmp_path / "none.bam"), 2, require=True)


def test_kernels():
    assert K.fnv1a64(b"a") == 0xAF63DC4C8601EC8C and K.fnv1a64(b"foobar") == 0x85944171F73967E8
    values = [b"", b"a", b"foobar", b"foo", bytes(range(256))]
    assert K.fnv1a64_many(values).tolist() == [K.fnv1a64(v) for v in values]
    state, want = 1234567, []
    for _ in range(4):
        state = state + K.GAMMA & K.MASK
        x = (state ^ state >> 30) * K.MIX_1 & K.MASK
        x = (x ^ x >> 27) * K.MIX_2 & K.MASK
        want.append(x ^ x >> 31)
    import numpy as np

    assert K.splitmix64(1234567, np.arange(4)).tolist() == want
    for sequence in ("ACGT", "ACGTN", "=", "acgtn"):
        assert K.decode_bases(K.encode_bases(sequence), len(sequence)) == sequence.upper()
    assert K.decode_quality(b"\xff\xff") == "*" and K.decode_quality(bytes([0, 40])) == "!I"
    with pytest.raises(ValueError):
        K.decode_quality(b"\xff\x01")
    with pytest.raises(ValueError):
        K.walk_aux(b"NMi\1")


def test_cram_reference_policies(tmp_path):
    from readloom.sources import cram

    path, fasta = str(tmp_path / "a.cram"), str(tmp_path / "r.fa")
    open(path, "wb").write(b"CRAM\3\0")
    open(fasta, "w").write(">a\nA\n")
    for options, code in (
        ({}, "missing_reference"),
        ({"reference": fasta}, "missing_reference_index"),
        ({"policy": "allow-cache"}, "unimplemented"),
        ({"policy": "any"}, "invalid_argument"),
        ({"policy": "allow-embedded"}, "unimplemented"),
    ):
        with pytest.raises(ReadloomError) as e:
            cram.read_cram(path, **options)
        assert e.value.code == code
    open(fasta + ".fai", "w").write("a\t1\t3\t1\t2\n")
    assert cram.resolve_reference(path, fasta).fasta == fasta
    # an explicit reference comes before the policy and the cache
    assert cram.resolve_reference(path, fasta, "allow-cache", "/somewhere").fasta == fasta
    with pytest.raises(ReadloomError, match="unimplemented"):
        cram.resolve_reference(path, None, "auto-conservative", "/somewhere")
    assert cram.resolve_reference(path, policy="auto-conservative").fasta is None
