"""Logical schemas of the engine's tables."""

from __future__ import annotations

CHROM_SIZES = "chrom_id int, chrom string, length bigint"
ALIGNMENTS = "rec_no bigint, qname string, flag int, chrom string, pos0 bigint, mapq int, cigar string, seq string, qual string, tags map<string,string>"
HITS = "chrom string, pos bigint, strand int, read_len int"
BED = "chrom string, start bigint, end bigint"
READS = "read_no bigint, id string, seq string, qual string"
BARCODES = "barcode_id int, name string, barcode string"
ADAPTERS = "adapter_id int, adapter string, three boolean, anchored boolean, reverse boolean, overhang int"
