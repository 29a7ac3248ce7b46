"""Schemas of the relations that operators share."""

from __future__ import annotations

#: One row per alignment record, in encounter order per source; -1 stands for no reference or position.
READS = (
    "source string, ordinal long, block_size int, ref_id int, pos int, bin int, mapq int, flags int, n_cigar int, l_seq int, "
    "next_ref_id int, next_pos int, tlen int, read_name string, cigar binary, seq_packed binary, qual binary, aux_bytes binary"
)
#: One row per raw read.
FASTQ = "source string, ordinal long, raw_header string, read_name string, sequence string, plus_line string, quality string"
REFS = "index int, name string, length long, m5 string, uri string, assembly string, species string, topology string, text_header_length long"
READ_GROUPS = "pos int, id string, sample string, library string, platform string, platform_unit string, center string, description string, date string, other_fields map<string,string>"
PROGRAMS = "pos int, id string, name string, version string, command_line string, previous_program_id string, description string, other_fields map<string,string>"
FINDING = "severity string, scope string, code string, message string, record_index long, reference_name string, tag string"

# Fixed values of the public alignment format: flag bits.
PAIRED, PROPER_PAIR, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
UNMAPPED_BIN = 4680
