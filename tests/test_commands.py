"""Commands end to end on small files made here."""

import random

import pytest

from readloom.plans.commands import COMMANDS, to_json
from readloom.sources import bam, sam

HEAD = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:chrA\tLN:5000\n@SQ\tSN:chrB\tLN:700\n@RG\tID:g1\tSM:s1\tPL:ILLUMINA\n@PG\tID:p1\n"


def sam_text(n, seed=0, head=HEAD, group="g1"):
    rng, out = random.Random(seed), [head]
    for i in range(n):
        flag = rng.choice([0, 16, 4, 256, 1024])
        where = ("*", 0, "*") if flag == 4 else (rng.choice(["chrA", "chrB"]), rng.randrange(1, 600), "6M")
        rg = f"\tRG:Z:{group}" if i % 3 else ""
        out.append(f"r{rng.randrange(500)}\t{flag}\t{where[0]}\t{where[1]}\t{rng.randrange(60)}\t{where[2]}\t*\t0\t0\tACGTAC\tIIIIII\tNM:i:{i % 4}{rg}\n")
    return "".join(out)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("commands")
    paths = {}
    for name, text in (("a", sam_text(200)), ("b", sam_text(80, 1)), ("other", sam_text(5, 2, HEAD.replace("700", "701")))):
        source = str(base / f"{name}.sam")
        open(source, "w").write(text)
        paths[name] = str(base / f"{name}.bam")
        bam.write_bam(sam.read_sam(spark, source).orderBy("ordinal"), sam.read_header(source), paths[name], f"file://{base}/{name}.parts")
    bam.register(spark)
    fq = str(base / "reads.fastq")
    open(fq, "w").write("".join(f"@q{i % 60}\nACGTAC\n+\nIIIIII\n" for i in range(120)))
    return base, paths, fq


def ok(spark, name, path, **options):
    got = COMMANDS[name](spark, path, **options)
    assert got["ok"], got["error"]
    assert set(got) == {"ok", "command", "path", "analysis_wall_seconds", "data", "error"} and to_json(got)
    return got["data"]


def fails(spark, name, path, code, **options):
    got = COMMANDS[name](spark, path, **options)
    assert not got["ok"] and got["error"]["code"] == code, got


def names(spark, path):
    return [r.read_name for r in spark.read.format("bam").load(path).orderBy("ordinal").collect()]


def test_reports(spark, made):
    base, paths, fq = made
    assert ok(spark, "identify", paths["a"])["format"] == "BAM" and ok(spark, "check_eof", paths["a"])
    assert ok(spark, "enumerate", paths["a"])["records"] == 200 and ok(spark, "enumerate", fq)["records"] == 120
    full, bounded = ok(spark, "summary", paths["a"], full_scan=True, include_mapq_hist=True), ok(spark, "summary", paths["a"], sample_records=200)
    assert full["mode"] == "full_scan" and bounded["mode"] == "bounded_scan" and sum(full["mapq_histogram"].values()) == 200
    assert ok(spark, "summary", paths["a"], sample_records=201)["mode"] == "full_scan"
    assert ok(spark, "check_map", paths["a"])["mapping_status"] == "mapped"
    assert ok(spark, "check_sort", paths["a"])["order"] == "unsorted"
    assert ok(spark, "check_tag", paths["a"], tag="NM")["records_examined"] == 1
    assert ok(spark, "check_tag", paths["a"], tag="ZZ", full_scan=True)["result"] == "absent_in_full_scan"
    fails(spark, "check_tag", paths["a"], "invalid_tag", tag="N")
    assert ok(spark, "validate", paths["a"])["valid"]
    assert ok(spark, "forensic_inspect", paths["a"], full_scan=True)["likely_concatenation_or_coercion"] is False
    assert ok(spark, "header", paths["a"])["references"][1] == {"name": "chrB", "length": 700}
    assert ok(spark, "check_index", paths["a"])["state"] == "absent"
    fails(spark, "verify", fq, "not_bam")
    fails(spark, "index", paths["a"], "unimplemented")


def test_sort_and_checksums(spark, made):
    base, paths, _ = made
    out = str(base / "sorted.bam")
    done = ok(spark, "sort", paths["a"], out=out, verify_checksum=True)
    assert done["records"] == 200 and ok(spark, "header", out)["text"].startswith("@HD\tVN:1.6\tSO:coordinate\n")
    before, after = ok(spark, "checksum", paths["a"]), ok(spark, "checksum", out)
    assert before["canonical_record_order"] == after["canonical_record_order"] and before["raw_record_order"] != after["raw_record_order"]
    fails(spark, "sort", paths["a"], "output_exists", out=out)
    fails(spark, "sort", paths["a"], "unimplemented", out=out + "2", by="queryname", suborder="natural")
    by_name = str(base / "named.bam")
    ok(spark, "sort", paths["a"], out=by_name, by="queryname")
    assert names(spark, by_name) == sorted(names(spark, paths["a"]), key=str.encode)
    assert ok(spark, "check_sort", by_name)["order"] == "queryname"


def test_merge_and_consume(spark, made):
    base, paths, fq = made
    out = str(base / "merged.bam")
    assert ok(spark, "merge", paths["a"], inputs=(paths["b"],), out=out, verify_checksum=True)["records"] == 280
    assert names(spark, out) == names(spark, paths["a"]) + names(spark, paths["b"])
    fails(spark, "merge", paths["a"], "incompatible_headers", inputs=(paths["other"],), out=out + "2")
    fails(spark, "consume", paths["a"], "mixed_inputs", inputs=(fq,), out=out + "3")
    fails(spark, "consume", fq, "mode_mismatch", out=out + "3")
    raw = str(base / "raw.bam")
    assert ok(spark, "consume", fq, out=raw, mode="unmapped", read_group="x", sample_name="s")["records"] == 120
    rows = bam.decoded(spark.read.format("bam").load(raw))
    assert rows.where("flags = 4 AND ref_id = -1 AND rg = 'x' AND sequence = 'ACGTAC' AND bin = 4680").count() == 120
    back = str(base / "back.fastq")
    ok(spark, "fastq", raw, out=back)
    assert open(back).read() == open(fq).read()


def test_modification_tags_ride_in_read_headers(spark, made):
    base, _, _ = made
    source, out, back = str(base / "meth.fastq"), str(base / "meth.bam"), str(base / "meth.back.fastq")
    text = "@m1 MM:Z:C+m,1,0; ML:B:C,42,7 MN:i:6\nACGTAC\n+\nIIIIII\n@m2\nAC\n+\nII\n"
    open(source, "w").write(text)
    ok(spark, "consume", source, out=out, mode="unmapped")
    assert bam.decoded(spark.read.format("bam").load(out)).where("read_name = 'm1'").first().tags == ["MM", "ML", "MN"]
    ok(spark, "fastq", out, out=back)
    assert open(back).read() == text
    open(source, "w").write(text.replace("MN:i:6", "MN:i:7"))
    with pytest.raises(Exception, match="invalid_fastq"):
        COMMANDS["consume"](spark, source, out=out, mode="unmapped", force=True)


def test_rewrites(spark, made):
    base, paths, _ = made
    out = str(base / "unmapped.bam")
    assert ok(spark, "unmap", paths["a"], out=out)["records"] == 200
    rows = bam.decoded(spark.read.format("bam").load(out))
    assert rows.where("flags & 4 = 0 OR ref_id <> -1 OR mapq <> 0 OR array_contains(tags, 'NM')").count() == 0
    fails(spark, "annotate_rg", paths["a"], "missing_read_group", rg_id="new", out=out + "1")
    fails(spark, "annotate_rg", paths["a"], "read_group_conflict", rg_id="new", out=out + "1", header_policy="create")
    counts = ok(spark, "annotate_rg", paths["a"], rg_id="new", out=out + "1", header_policy="create", mode="replace-existing")
    assert counts["records_inserted"] == 67 and counts["records_replaced"] == 133
    assert bam.decoded(spark.read.format("bam").load(out + "1")).where("rg = 'new'").count() == 200
    ok(spark, "reheader", paths["a"], out=out + "2", add_rg=[{"ID": "g9"}], comments=["hello"])
    assert "@RG\tID:g9\n@CO\thello\n" in ok(spark, "header", out + "2")["text"]
    assert ok(spark, "checksum", out + "2")["raw_record_order"] == ok(spark, "checksum", paths["a"])["raw_record_order"]
    fails(spark, "reheader", paths["a"], "unimplemented", in_place=True)


def test_subsample_and_deduplicate(spark, made):
    base, paths, fq = made
    kept = []
    for f in (0.2, 0.6, 1.0):
        out = str(base / f"sub{f}.bam")
        ok(spark, "subsample", paths["a"], out=out, fraction=f, mode="deterministic", identity="full_record")
        kept.append(names(spark, out))
    assert set(kept[0]) <= set(kept[1]) <= set(kept[2]) and kept[2] == names(spark, paths["a"])
    runs = [ok(spark, "subsample", paths["a"], fraction=0.5, seed=s, dry_run=True)["records_retained"] for s in (1, 1, 2)]
    assert runs[0] == runs[1] and 60 < runs[2] < 140
    fails(spark, "subsample", paths["a"], "invalid_argument", fraction=0.0, dry_run=True)
    found = ok(spark, "inspect_duplication", fq, min_block_size=60)
    assert found["findings"][0]["finding"] == "whole_file_append_duplicate" and found["likely_operator_error"]
    assert ok(spark, "inspect_duplication", fq, min_block_size=50)["findings"][0]["finding"] == "partial_collection_duplicate"
    out = str(base / "single.fastq")
    assert ok(spark, "deduplicate", fq, out=out, min_block_size=60)["records_removed"] == 60
    assert open(out).read() == "".join(open(fq).readlines()[:240])
    fails(spark, "deduplicate", fq, "unimplemented", out=out, mode="global-exact")


def test_every_command_is_there():
    assert set(COMMANDS) == {
        "identify", "enumerate", "subsample", "inspect_duplication", "deduplicate", "forensic_inspect", "annotate_rg", "consume", "fastq", "checksum", "merge", "reheader",
        "sort", "unmap", "verify", "check_eof", "header", "check_sort", "check_map", "check_index", "index", "summary", "check_tag", "validate",
    }


def test_arriving_files(spark, made, tmp_path):
    from readloom.streaming.arrivals import arriving_records, running_counts

    _, _, fq = made
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.fastq").write_text(open(fq).read())
    query = running_counts(arriving_records(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert tuple(spark.sql("SELECT files, records, bases FROM arrived").first()) == (1, 120, 720)
    finally:
        query.stop()


def blocked(spark, base, name, texts):
    """A BAM of unmapped records with the given names."""
    source, out = str(base / f"{name}.sam"), str(base / f"{name}.bam")
    open(source, "w").write(HEAD + "".join(f"{t}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\n" for t in texts))
    bam.write_bam(sam.read_sam(spark, source).orderBy("ordinal"), sam.read_header(source), out, f"file://{base}/{name}.parts", True)
    return out


def test_reported_ranges_are_those_removed(spark, made):
    base, _, _ = made
    block = [f"b{i}" for i in range(50)]
    path = blocked(spark, base, "inner", [f"a{i}" for i in range(30)] + block + block + [f"z{i}" for i in range(30)])
    out = str(base / "inner.out.bam")
    done = ok(spark, "deduplicate", path, out=out, mode="whole-file-append", verify_checksum=True)
    assert (done["records_removed"], done["removed_ranges"], done["records_written"]) == (0, [], 160) and names(spark, out) == names(spark, path)
    done = ok(spark, "deduplicate", path, out=out, force=True, verify_checksum=True)
    assert (done["records_removed"], done["removed_ranges"], done["records_written"]) == (50, [[81, 130]], 110) and done["checksum"]["matched"]
    assert names(spark, out) == [n for i, n in enumerate(names(spark, path)) if not 80 <= i < 130]
    whole = blocked(spark, base, "whole", block + block)
    assert ok(spark, "deduplicate", whole, mode="whole-file-append", keep="last", dry_run=True, verify_checksum=True)["removed_ranges"] == [[1, 50]]


def codes(data):
    return [(f["severity"], f["code"], f["record_index"]) for f in data["findings"]]


def test_validation_of_damaged_files(spark, made):
    from readloom.sources import bgzf

    base, _, _ = made
    source = str(base / "sound.sam")
    flags = [0, 0, 77, 0, 192, 0]
    open(source, "w").write(HEAD + "".join(f"r{i}\t{f}\tchrA\t{i + 1}\t9\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\n" for i, f in enumerate(flags)))
    path = str(base / "sound.bam")
    head = sam.read_header(source)
    bam.write_bam(sam.read_sam(spark, source).orderBy("ordinal"), head, path, f"file://{base}/sound.parts")
    rows = [r.asDict() for r in spark.read.format("bam").load(path).orderBy("ordinal").collect()]
    raw = [bam.encode_record(r) for r in rows]

    def report(body, end=bgzf.EOF_MARKER, begin=None, **options):
        target = str(base / "damaged.bam")
        open(target, "wb").write(bgzf.deflate(head.binary() if begin is None else begin) + bgzf.deflate(body) + end)
        got = COMMANDS["validate"](spark, target, **options)
        assert got["error"] is None, got
        assert got["ok"] == got["data"]["valid"]
        return got["data"]

    flagged = [("error", "contradictory_mapping_state", 3), ("warning", "read1_and_read2_both_set", 5)]
    sound = report(b"".join(raw), include_warnings=True)
    assert codes(sound) == [("info", "bgzf_eof_present", None), *flagged]
    assert (sound["records_examined"], sound["full_file_examined"], sound["errors"], sound["warnings"], sound["mode"]) == (6, True, 1, 1, "full")
    assert codes(report(b"".join(raw), b"")) == [flagged[0]]
    assert report(b"".join(raw), b"")["warnings"] == 2
    # findings beyond the limit, or after the first error, are neither counted nor stored
    few = report(b"".join(raw), records=2, include_warnings=True)
    assert (codes(few)[1:], few["records_examined"], few["valid"], few["mode"], few["full_file_examined"]) == ([], 2, True, "bounded_records", False)
    quick = report(b"".join(raw), fail_fast=True, include_warnings=True)
    assert (codes(quick)[1:], quick["records_examined"], quick["warnings"]) == (flagged[:1], 3, 0)
    cut = report(b"".join(raw)[:-5], include_warnings=True)
    assert codes(cut)[1:] == [*flagged, ("error", "truncated_record", 6)] and cut["records_examined"] == 5 and not cut["full_file_examined"]
    assert report(b"".join(raw)[:-5], records=5)["errors"] == 1
    short = report(b"".join(raw[:3]) + b"\x10\0\0\0" + b"".join(raw[3:]))
    assert codes(short)[1:] == [flagged[0], ("error", "invalid_record", 4)] and short["records_examined"] == 3
    # more bases than the record has room for
    wide = raw[1][:20] + b"\xff\0\0\0" + raw[1][24:]
    broken = report(raw[0] + wide + b"".join(raw[2:]))
    assert codes(broken)[1:] == [("error", "invalid_record", 2)] and broken["records_examined"] == 1
    aux = bam.encode_record(rows[0] | {"aux_bytes": b"NMC\1NMC\2XB"})
    torn = report(b"".join(raw[:2]) + aux, include_warnings=True)
    assert codes(torn)[1:] == [("warning", "duplicate_aux_tag", 3), ("error", "malformed_aux_region", 3)]
    assert [f["tag"] for f in torn["findings"][1:]] == ["NM", None] and torn["findings"][1]["scope"] == "aux"
    lost = report(b"", begin=head.binary()[:-6])
    assert codes(lost)[1:] == [("error", "invalid_header", None)] and not lost["header_valid"] and lost["records_examined"] == 0
    many = report(b"".join(raw[:3]) * 4, max_errors=2)
    assert many["errors"] == 4 and codes(many)[1:] == [("error", "contradictory_mapping_state", 3), ("error", "contradictory_mapping_state", 6)]


def test_options_of_reports(spark, made):
    import hashlib

    base, paths, _ = made
    assert ok(spark, "check_tag", paths["a"], tag="NM", require_type="c", full_scan=True)["result"] == "observed_present"
    assert ok(spark, "check_tag", paths["a"], tag="NM", require_type="Z", full_scan=True)["result"] == "absent_in_full_scan"
    fails(spark, "check_tag", paths["a"], "invalid_tag_type", require_type="q")
    plain, flags = ok(spark, "summary", paths["a"]), ok(spark, "summary", paths["a"], include_flags=True, prefer_index=True)
    assert "flag_categories" not in plain and flags["flag_categories"]["reverse_strand_records"] > 0 and flags["index_used"] is False
    assert ok(spark, "check_sort", paths["a"], sample_records=1)["records_examined"] == 1
    strict = ok(spark, "check_sort", paths["a"], sample_records=1, strict=True)
    assert strict["order"] == "unsorted" and strict["records_examined"] > 1
    head = bam.read_header(paths["b"])
    frame = lambda b: len(b).to_bytes(8, "little") + b
    rows = [r.asDict() for r in spark.read.format("bam").load(paths["b"]).orderBy("ordinal").collect()]
    records = [bam.digested(r) for r in rows]
    got = ok(spark, "checksum", paths["b"], include_header=True)
    digest = lambda parts: hashlib.sha256(b"".join(map(frame, parts))).hexdigest()
    assert got["raw_record_order"] == digest(records) and got["payload"] == digest([head.digested(), *records])
    assert got["canonical_record_order"] == digest(sorted(hashlib.sha256(frame(r)).digest() for r in records)) and got["header"] == digest([head.digested()])
    assert ok(spark, "checksum", paths["b"], mode="payload")["payload"] == got["raw_record_order"]
