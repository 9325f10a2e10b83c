"""Readers and writers of sequencing files: SAM and BAM, FASTQ and FASTA (plain, gzip, bzip2), BED; tracks and reports."""
