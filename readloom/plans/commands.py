"""Commands: one call per entry point, each giving an envelope {ok, command, path, analysis_wall_seconds, data, error}."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.errors import ReadloomError, unimplemented
from readloom.operators import duplicates, forensic, order, profile, rewrite, sample, validate
from readloom.operators.checksum import framed
from readloom.sources import bam, bgzf, fastq, files, index, probe, sam
from readloom.sources.header import Header
from readloom.sources.header import reheader as change_header

COMMANDS: dict[str, Callable] = {}

# Fixed values of the public format: the type codes of aux fields.
AUX_TYPES = ("A", "c", "C", "s", "S", "i", "I", "f", "Z", "H", "B")


def command(name: str):
    """Register a command whose result, or error, is put in an envelope."""

    def wrap(f):
        @wraps(f)
        def run(spark: SparkSession, path: str, **options) -> dict:
            began = time.time()
            envelope = {"ok": True, "command": name, "path": path, "analysis_wall_seconds": None, "data": None, "error": None}
            try:
                envelope["data"] = f(spark, path, **options)
                if isinstance(envelope["data"], dict) and envelope["data"].get("valid") is False:
                    envelope["ok"] = False
            except ReadloomError as e:
                envelope |= {"ok": False, "error": {"code": e.code, "message": e.message, "detail": e.detail, "hint": e.hint}}
            envelope["analysis_wall_seconds"] = round(time.time() - began, 6)
            return envelope

        COMMANDS[name] = run
        return run

    return wrap


def to_json(envelope: dict, pretty: bool = False) -> str:
    return json.dumps(envelope, indent=2 if pretty else None, default=str)


def _one(df: DataFrame) -> dict:
    return df.first().asDict()


def _bam(spark: SparkSession, path: str) -> DataFrame:
    probe.verify(path)
    return bam.read_bam(spark, path)


def _any(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """A collection's reads with text columns, by format: BAM, SAM or FASTQ."""
    kind = probe.probe(path).format
    if kind == "BAM":
        return kind, bam.decoded(_bam(spark, path))
    if kind == "SAM":
        return kind, bam.decoded(sam.read_sam(spark, path))
    if kind in ("FASTQ", "FASTQ.GZ"):
        rows = fastq.read_fastq(spark, path)
        return kind, rows.withColumns({"rg": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})
    if kind == "CRAM":
        raise unimplemented("CRAM decoding")
    raise ReadloomError("unsupported_format", f"{path} is {kind}")


def _scratch(spark: SparkSession, name: str) -> str:
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ReadloomError("invalid_argument", "spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _write(spark: SparkSession, reads: DataFrame, header: Header, out: str, force: bool) -> int:
    return bam.write_bam(reads, header, out, _scratch(spark, "write-bam"), force)


@command("identify")
def identify(spark, path):
    found = probe.probe(path)
    return {"format": found.format, "container": found.container, "confidence": found.confidence}


@command("verify")
def verify(spark, path):
    return {"format": probe.verify(path).format}


@command("check_eof")
def check_eof(spark, path):
    probe.check_eof(path)
    return {"complete": True}


@command("header")
def header(spark, path):
    head = bam.read_header(path)
    return {"text": head.text(), "references": [{"name": n, "length": k} for n, k in head.references]}


@command("enumerate")
def enumerate_(spark, path, compat: bool = False):
    kind = probe.probe(path).format
    if kind == "FASTA":
        return {"format": kind, "records": fastq.count_fasta(spark, path)}
    if kind in ("FASTQ", "FASTQ.GZ"):
        return {"format": kind, "records": fastq.count_fastq(spark, path, compat=compat)}
    return {"format": kind, "records": _any(spark, path)[1].count()}


@command("summary")
def summary(spark, path, sample_records: int = 100_000, full_scan: bool = False, prefer_index: bool = False, include_mapq_hist: bool = False, include_flags: bool = False):
    reads, head = _bam(spark, path), bam.read_header(path)
    limit = None if full_scan else sample_records
    out = _one(profile.summary(reads, limit, len(head.references)))
    flags = {k: out.pop(k) for k in list(out) if k.removesuffix("_records") in profile.FLAG_CATEGORIES}
    if include_flags:
        out["flag_categories"] = flags
    out["index_used"] = False
    state = index.check_index(path, len(head.references)) if prefer_index else {"state": None}
    if state["state"] == "plausible":
        counts, unplaced = index.parse_bai(state["path"], len(head.references))
        mapped, unmapped = sum(c[0] for c in counts if c), sum(c[1] for c in counts if c) + (unplaced or 0)
        out |= {"index_used": True, "index_derived": {"total_mapped_reads": mapped, "total_unmapped_reads": unmapped, "references_with_mapped_reads": sum(1 for c in counts if c and c[0])}}
    if include_mapq_hist:
        out["mapq_histogram"] = {r["mapq"]: r["records"] for r in profile.mapq_histogram(profile.bounded(reads, limit)).collect()}
    return out


@command("check_map")
def check_map(spark, path, sample_records: int = 10_000, full_scan: bool = False, prefer_index: bool = True):
    head = bam.read_header(path)
    state = index.check_index(path, len(head.references))
    if prefer_index and state["state"] == "plausible":
        counts, unplaced = index.parse_bai(state["path"], len(head.references))
        mapped, unmapped = sum(c[0] for c in counts if c), sum(c[1] for c in counts if c) + (unplaced or 0)
        return {"evidence_source": "index", "mapping_status": "mapped" if mapped else "unmapped", "total_mapped_reads": mapped, "total_unmapped_reads": unmapped, "confidence": "high"}
    out = _one(profile.check_map(_bam(spark, path), None if full_scan else sample_records))
    return out | {"evidence_source": "scan", "index": state["state"]}


@command("check_sort")
def check_sort(spark, path, sample_records: int = 10_000, strict: bool = False):
    """``strict`` goes on to the end of the file, or until all orders are broken."""
    hd = next(iter(bam.read_header(path).records("HD")), {})
    return {"declared": hd.get("SO"), **_one(order.check_sort(_bam(spark, path), None if strict else sample_records, hd.get("SO"), hd.get("SS")))}


@command("check_tag")
def check_tag(spark, path, tag: str = "NM", sample_records: int = 100_000, full_scan: bool = False, count_hits: bool = False, require_type: str | None = None):
    if len(tag) != 2 or not tag.isascii() or not tag.isprintable() or " " in tag:
        raise ReadloomError("invalid_tag", tag)
    if require_type is not None and require_type not in AUX_TYPES:
        raise ReadloomError("invalid_tag_type", require_type)

    def fields(arrow):
        import pyarrow as pa

        from readloom.functions.kernels import walk_aux

        kind = pa.list_(pa.struct([("tag", pa.string()), ("type", pa.string())]))
        for batch in arrow:
            found = [[{"tag": t, "type": k} for t, k, _ in walk_aux(raw)] for raw in batch.column("aux_bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("ordinal"), pa.array(found, kind)], ["ordinal", "aux"])

    reads = _bam(spark, path).select("ordinal", "aux_bytes").mapInArrow(fields, "ordinal long, aux array<struct<tag string, type string>>")
    return _one(profile.check_tag(reads, tag, None if full_scan else sample_records, require_type, count_hits)) | {"required_type": require_type}


@command("check_index")
def check_index(spark, path, require: bool = False, prefer_csi: bool = False):
    return index.check_index(path, len(bam.read_header(path).references), require, prefer_csi)


@command("index")
def build_index(spark, path, out: str | None = None, force: bool = False):
    kind = probe.probe(path).format
    if kind != "FASTQ.GZ":
        raise unimplemented(f"indexing of {kind}")
    summary_, points = fastq.build_gzi(path)
    fastq.write_gzi(out or f"{path}.gzi", summary_, points, force)
    return summary_ | {"checkpoints": len(points)}


def _record_findings(spark: SparkSession, path: str, records: int | None, fail_fast: bool, most: dict[str, int]) -> dict:
    """What the records' scan tells: how far it came, the number of findings by severity, and the first of them."""
    ranges, damage = bam.plan_bam(spark, path)
    total = sum(r.records for r in ranges)
    reads = profile.bounded(bam.planned(spark, path, ranges, mark=True), records)
    scratch = _scratch(spark, "validate")
    validate.body_findings(reads).write.parquet(scratch)
    found = spark.read.parquet(scratch)
    first = found.agg(F.min(F.when(F.col("code") == "invalid_record", F.col("record_index"))).alias("bad"), F.min(F.when(F.col("severity") == "error", F.col("record_index"))).alias("error")).first()
    extent = damage[:2] if damage and (records is None or damage[1] <= records) else None
    bad, code = min([(first["bad"], "invalid_record")] if first["bad"] else [], default=(None, ""))
    if extent and (bad is None or extent[1] < bad):
        bad, code = extent[1], extent[0]
    examined = min(total, records) if records is not None else total
    examined = examined if bad is None else bad - 1
    stopped = fail_fast and first["error"] is not None and first["error"] <= examined
    examined = first["error"] if stopped else examined
    within = found.where(F.col("record_index") <= examined).where("code <> 'invalid_record'")
    counts = {r["severity"]: r["n"] for r in within.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows: list[dict] = []
    for severity, n in most.items():
        few = within.where(F.col("severity") == severity).orderBy("record_index", "place").limit(max(n, 0))
        rows += [r.asDict() for r in few.collect()]
    rows.sort(key=lambda r: (r["record_index"], r.pop("place")))
    if bad is not None and not stopped:
        counts["error"] = counts.get("error", 0) + 1
        if sum(r["severity"] == "error" for r in rows) < most["error"]:
            rows.append({"severity": "error", "scope": "record", "code": code, "tag": None, "record_index": bad})
    files.remove_folder(scratch)
    complete = bad is None and not stopped and (records is None or total < records)
    return {"examined": examined, "complete": complete, "counts": counts, "rows": rows}


@command("validate")
def validate_(spark, path, max_errors: int = 100, max_warnings: int = 100, header_only: bool = False, records: int | None = None, fail_fast: bool = False, include_warnings: bool = False):
    mode = "header_only" if header_only else "full" if records is None else "bounded_records"
    blank = {"tag": None, "record_index": None, "reference_name": None}
    marker = files.tail(path, 28)
    rows = [blank | {"severity": "info", "scope": "file", "code": "bgzf_eof_present"} if marker == bgzf.EOF_MARKER else blank | {"severity": "warning", "scope": "file", "code": "missing_bgzf_eof"}]
    body = {"examined": 0, "complete": False, "counts": {}, "rows": []}
    try:
        head = bam.read_header(path)
    except validate.HEADER_ERRORS as e:
        rows.append(blank | {"severity": "error", "scope": "header", "code": "invalid_header", "detail": str(e)})
    else:
        text = Header.parse_text(head.text())
        sq = spark.createDataFrame(text.references, "name string, length long")
        found = validate.header_findings(head.refs(spark).select("index", "name", "length"), sq, head.read_groups(spark), head.programs(spark))
        rows += [blank | r.asDict() for r in found.collect()]
        broken = any(r["severity"] == "error" for r in rows)
        if not header_only and not (fail_fast and broken):
            stored = {s: n - sum(r["severity"] == s for r in rows) for s, n in (("error", max_errors), ("warning", max_warnings))}
            body = _record_findings(spark, path, records, fail_fast, stored)
    counts = {s: sum(r["severity"] == s for r in rows) + body["counts"].get(s, 0) for s in ("error", "warning", "info")}
    caps = {"error": max_errors, "warning": max_warnings if include_warnings else 0, "info": len(rows)}
    findings = []
    for r in [*rows, *(blank | r for r in body["rows"])]:
        caps[r["severity"]] -= 1
        if caps[r["severity"]] >= 0:
            findings.append(r)
    return {
        "mode": mode,
        "valid": counts["error"] == 0,
        "header_valid": not any(r["severity"] == "error" and r["scope"] == "header" for r in rows),
        "records_examined": body["examined"],
        "full_file_examined": body["complete"],
        "errors": counts["error"],
        "warnings": counts["warning"],
        "infos": counts["info"],
        "findings": findings,
    }


@command("inspect_duplication")
def inspect_duplication(spark, path, identity: str = "qname_seq_qual", min_block_size: int = 50, sample_records: int = 100_000, full_scan: bool = False, max_findings: int = 25):
    reads = profile.bounded(_any(spark, path)[1], None if full_scan else sample_records)
    found = [r.asDict() for r in duplicates.duplication_findings(reads, identity, min_block_size, max_findings).collect()]
    summary_ = _one(duplicates.dup_summary(reads, identity))
    error = any(r["finding"] != "exact_record_duplicate" for r in found)
    return {"summary": summary_, "findings": found, "duplication_detected": bool(found) or summary_["duplicate_identities"] > 0, "likely_operator_error": error}


@command("deduplicate")
def deduplicate(spark, path, out: str = "", mode: str = "contiguous-block", identity: str = "qname_seq_qual", keep: str = "first", min_block_size: int = 50, dry_run: bool = False, force: bool = False, verify_checksum: bool = False):
    """Ranges are those that are removed; with ``verify_checksum`` a BAM output's records are compared with the input's that stay."""
    kind, reads = _any(spark, path)
    ranges = duplicates.blocks_to_remove(reads, mode, identity, keep, min_block_size)
    done = {"removed_ranges": [[a + 1, z] for a, z in ranges], "records_removed": sum(z - a for a, z in ranges), "dry_run": dry_run}
    if dry_run:
        return done | ({"checksum": {"performed": False}} if verify_checksum else {})
    left = duplicates.remove_ranges(reads, ranges)
    if kind != "BAM":
        fastq.write_fastq(rewrite.to_fastq_text(left), out, force)
        return done | ({"checksum": {"performed": False}} if verify_checksum else {})
    done["records_written"] = _write(spark, left.orderBy("ordinal"), bam.read_header(path), out, force)
    if verify_checksum:
        raw = duplicates.remove_ranges(_bam(spark, path), ranges)
        before, after = bam.checksum(raw, True), bam.checksum(_bam(spark, out), True)
        if before != after:
            raise ReadloomError("checksum_mismatch", "the output's records aren't those that were to stay")
        done["checksum"] = {"performed": True, "digest": after, "matched": True}
    return done


@command("forensic_inspect")
def forensic_inspect(spark, path, sample_records: int = 100_000, full_scan: bool = False, scopes: tuple[str, ...] = ("header", "rg", "pg", "readnames", "duplication"), max_findings: int = 25):
    head = bam.read_header(path)
    body = bool(set(scopes) - {"header", "pg"})
    reads = profile.bounded(bam.decoded(_bam(spark, path)), None if full_scan else sample_records) if body else None
    found = forensic.forensic_findings(reads, head.read_groups(spark), head.programs(spark), tuple(scopes), sum(k == "CO" for k, _ in head.lines), max_findings)
    return {"findings": [r.asDict() for r in found.collect()], **_one(forensic.assessment(found, full_scan, body))}


@command("subsample")
def subsample(spark, path, out: str = "", fraction: float = 0.1, mode: str = "random", seed: int = 0, identity: str = "full_record", mapped_only: bool = False, primary_only: bool = False, dry_run: bool = False, force: bool = False):
    kind, reads = _any(spark, path)
    if kind == "BAM":
        name = F.encode("read_name", "UTF-8")
        size = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("l_seq", 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)], F.lit("00000000")))
        parts = {"qname": name, "qname_seq": F.concat(name, F.lit(b"\x00"), size, F.col("seq_packed"))}
        key = parts.get(identity)
        if key is None:
            reads, key = reads.join(bam.encoded(reads), "ordinal"), F.col("record")
    else:
        key = sample.fastq_identity(identity)
    kept = sample.subsample_random(reads, fraction, seed, mapped_only, primary_only) if mode == "random" else sample.subsample_hash(reads, fraction, key, mapped_only, primary_only)
    examined, retained = reads.count(), kept.count()
    if not dry_run:
        if kind == "BAM":
            _write(spark, kept.orderBy("ordinal"), bam.read_header(path), out, force)
        else:
            fastq.write_fastq(rewrite.to_fastq_text(kept), out, force)
    return {"records_examined": examined, "records_retained": retained, "observed_fraction": retained / examined if examined else None}


@command("sort")
def sort(spark, path, out: str = "", by: str = "coordinate", suborder: str | None = None, verify_checksum: bool = False, force: bool = False):
    reads = _bam(spark, path)
    head = bam.read_header(path).with_order(by)
    n = _write(spark, order.sort_reads(reads, by, suborder), head, out, force)
    result = {"records": n, "order": by}
    if verify_checksum:
        before, after = bam.checksum(reads, True), bam.checksum(_bam(spark, out), True)
        if before != after:
            raise ReadloomError("checksum_mismatch", "the output's records aren't the input's")
        result["checksum"] = after
    return result


def _merged(spark: SparkSession, paths: list[str], sort_by: str | None) -> tuple[DataFrame, Header, list[str]]:
    heads = [bam.read_header(p) if probe.probe(p).format == "BAM" else sam.read_header(p) for p in paths]
    for p, h in zip(paths[1:], heads[1:], strict=True):
        if h.references != heads[0].references:
            raise ReadloomError("incompatible_headers", f"{p} has other references than {paths[0]}")
    reads = [_bam(spark, p) if probe.probe(p).format == "BAM" else sam.read_sam(spark, p) for p in paths]
    kept = {f.get("ID") for f in heads[0].records("RG")}
    dropped = sorted({f["ID"] for h in heads[1:] for f in h.records("RG") if "ID" in f} - kept)
    head = heads[0].with_order(sort_by or "unsorted") if len(paths) > 1 or sort_by else heads[0]
    return rewrite.merge(reads, sort_by), head, dropped


@command("merge")
def merge(spark, path, inputs: tuple[str, ...] = (), out: str = "", sort_by: str | None = None, verify_checksum: bool = False, force: bool = False):
    paths = [path, *inputs]
    reads, head, dropped = _merged(spark, paths, sort_by)
    ordered = reads if sort_by else reads.orderBy("ordinal")
    n = _write(spark, ordered, head, out, force)
    result = {"records": n, "inputs": len(paths), "dropped_read_groups": dropped}
    if verify_checksum and bam.checksum(reads, True) != bam.checksum(_bam(spark, out), True):
        raise ReadloomError("checksum_mismatch", "the output's records aren't the inputs'")
    return result


@command("consume")
def consume(spark, path, inputs: tuple[str, ...] = (), out: str = "", mode: str = "alignment", recursive: bool = False, sort_by: str | None = None, dry_run: bool = False, sample_name: str | None = None, read_group: str | None = None, platform: str | None = None, force: bool = False):
    found = files.discover([path, *inputs], recursive)
    raw = [f.path for f in found if f.format in ("FASTQ", "FASTQ.GZ")]
    aligned = [f.path for f in found if f.format in ("BAM", "SAM")]
    if raw and aligned:
        raise ReadloomError("mixed_inputs", "raw and aligned inputs in one request")
    if (mode == "alignment") != bool(aligned):
        raise ReadloomError("mode_mismatch", f"inputs don't suit mode {mode}", str(files.format_counts(found)))
    if any(f.format == "CRAM" for f in found):
        raise unimplemented("CRAM decoding")
    if dry_run:
        return {"inputs": [f.path for f in found], "formats": files.format_counts(found), "dry_run": True}
    if mode == "alignment":
        reads, head, dropped = _merged(spark, aligned, sort_by)
        return {"records": _write(spark, reads if sort_by else reads.orderBy("ordinal"), head, out, force), "dropped_read_groups": dropped}
    if sort_by == "coordinate":
        raise ReadloomError("invalid_argument", "unmapped reads have no coordinates to sort by")
    rows = rewrite.merge([fastq.read_fastq(spark, p) for p in raw])
    lines: list = [("HD", [("VN", "1.6"), ("SO", sort_by or "unsorted")])]
    if read_group or sample_name or platform:
        lines.append(("RG", [("ID", read_group or "rg1"), *([("SM", sample_name)] if sample_name else []), *([("PL", platform)] if platform else [])]))
    encoded = rewrite.fastq_to_unmapped(rows, keep=("raw_header",)).withColumns({"next_ref_id": F.lit(-1), "next_pos": F.lit(-1), "tlen": F.lit(0), "n_cigar": F.lit(0), "block_size": F.lit(0)}).mapInArrow(_encode_unmapped(read_group), bam.S.READS)
    ordered = encoded.orderBy("read_name", "ordinal") if sort_by == "queryname" else encoded.orderBy("ordinal")
    return {"records": _write(spark, ordered, Header(lines), out, force)}


def _encode_unmapped(read_group: str | None):
    names = [c.split(" ")[0] for c in bam.S.READS.split(", ")]

    def encode(arrow):
        import pyarrow as pa

        from readloom.functions.kernels import encode_bases, encode_quality
        from readloom.functions.modifications import aux_of_header

        group = b"RGZ" + read_group.encode() + b"\0" if read_group else b""
        for batch in arrow:
            rows = batch.to_pylist()
            for r in rows:
                r |= {"seq_packed": encode_bases(r["sequence"]), "qual": encode_quality(r["quality"], r["l_seq"]), "cigar": b"", "aux_bytes": aux_of_header(r["raw_header"], r["l_seq"]) + group}
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=bam._ARROW)

    return encode


@command("unmap")
def unmap(spark, path, out: str | None = None, dry_run: bool = False, force: bool = False):
    reads = rewrite.unmap(_bam(spark, path))
    gone = set(rewrite.MAPPING_TAGS)

    def strip(arrow):
        import pyarrow as pa

        for batch in arrow:
            aux = pa.array([bam.without_tags(a, gone) for a in batch.column("aux_bytes").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("aux_bytes"), "aux_bytes", aux)

    stripped = reads.mapInArrow(strip, bam.S.READS)
    if dry_run:
        return {"records": reads.count(), "dry_run": True}
    head = bam.read_header(path).unmapped()
    return {"records": _write(spark, stripped.orderBy("ordinal"), head, out or f"{path.removesuffix('.bam')}.unmapped.bam", force)}


@command("annotate_rg")
def annotate_rg(spark, path, rg_id: str = "", out: str = "", mode: str = "fail-on-conflict", header_policy: str = "require-existing", dry_run: bool = False, force: bool = False):
    head = bam.read_header(path)
    exists = any(f.get("ID") == rg_id for f in head.records("RG"))
    if header_policy == "require-existing" and not exists:
        raise ReadloomError("missing_read_group", rg_id)
    if not exists:
        head = head.upsert("RG", {"ID": rg_id})
    reads = bam.decoded(_bam(spark, path))
    counts = _one(rewrite.annotate_rg_counts(reads, rg_id, mode))
    if counts["records_conflict"]:
        raise ReadloomError("read_group_conflict", f"{counts['records_conflict']} records carry another read group")
    if not dry_run:

        def put(arrow):
            import pyarrow as pa

            tag = b"RGZ" + rg_id.encode() + b"\0"
            for batch in arrow:
                aux = []
                for raw, action in zip(batch.column("aux_bytes").to_pylist(), batch.column("action").to_pylist(), strict=True):
                    aux.append(bam.without_tags(raw, {"RG"}) + tag if action in ("inserted", "replaced") else raw)
                done = batch.set_column(batch.schema.get_field_index("aux_bytes"), "aux_bytes", pa.array(aux, pa.binary()))
                yield done.select([f.name for f in bam._ARROW])

        _write(spark, rewrite.annotate_rg(reads, rg_id, mode).orderBy("ordinal").mapInArrow(put, bam.S.READS), head, out, force)
    return counts


@command("reheader")
def reheader(spark, path, out: str = "", in_place: bool = False, dry_run: bool = False, force: bool = False, **changes):
    if in_place:
        raise unimplemented("changing a header in place")
    head = change_header(bam.read_header(path), **changes)
    if not dry_run:
        _write(spark, _bam(spark, path).orderBy("ordinal"), head, out, force)
    return {"header": head.text(), "dry_run": dry_run}


@command("fastq")
def to_fastq(spark, path, out: str | None = None, force: bool = False):
    reads = bam.decoded(_bam(spark, path)).withColumn("quality", F.when(F.col("quality") != "*", F.col("quality")))
    target = out or f"{path}.fastq.gz"

    def rename(arrow):
        import pyarrow as pa

        from readloom.functions.modifications import header_words

        for batch in arrow:
            names = [" ".join([n, *header_words(a)]) for n, a in zip(batch.column("read_name").to_pylist(), batch.column("aux_bytes").to_pylist(), strict=True)]
            columns = [batch.column("ordinal"), pa.array(names), batch.column("sequence"), batch.column("quality")]
            yield pa.RecordBatch.from_arrays(columns, ["ordinal", "read_name", "sequence", "quality"])

    text = reads.select("ordinal", "read_name", "sequence", "quality", "aux_bytes").mapInArrow(rename, "ordinal long, read_name string, sequence string, quality string")
    fastq.write_fastq(rewrite.to_fastq_text(text), target, force)
    return {"records": reads.count(), "output": target}


@command("checksum")
def checksum(spark, path, mode: str = "all", exclude_tags: tuple[str, ...] = (), only_primary: bool = False, mapped_only: bool = False, include_header: bool = False):
    """``payload`` is records in order, after the header with ``include_header``."""
    reads = _bam(spark, path)
    reads = profile.primary_only(reads) if only_primary else reads
    reads = profile.mapped_only(reads) if mapped_only else reads
    head = bam.read_header(path).digested()
    out = {}
    if mode in ("all", "raw-record-order"):
        out["raw_record_order"] = bam.checksum(reads, False, exclude_tags)
    if mode in ("all", "canonical-record-order"):
        out["canonical_record_order"] = bam.checksum(reads, True, exclude_tags)
    if mode in ("all", "payload"):
        same = not include_header and "raw_record_order" in out
        out["payload"] = out["raw_record_order"] if same else bam.checksum(reads, False, exclude_tags, head if include_header else None)
    if mode in ("all", "header"):
        out["header"] = hashlib.sha256(framed(head)).hexdigest()
    if not out:
        raise ReadloomError("invalid_argument", f"no such mode: {mode}")
    return out
