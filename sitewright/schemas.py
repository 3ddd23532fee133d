"""Schemas of the tables that the operators work on.

Positions are 1-based; target intervals are 0-based and half-open. Qualities are text, one character a base,
33 above the value, so that a base and its quality are substrings at the same place.
"""

ALIGNMENTS = "file_idx int, ord long, ref_id int, pos long, flag int, mapq int, rg string, cigar string, seq string, qual string"
CONTIGS = "ref_id int, name string, length long"
READ_GROUPS = "rg string, sample string"
SAMPLES = "sample string, sample_idx int"
TARGETS = "ref_id int, start long, end long"
REFERENCE = "name string, length long, chunk_id long, seq string"
SITE_COUNTS = "ref_id int, pos long, sample_idx int, nA long, nC long, nG long, nT long"

#: Bases of one reference row.
CHUNK = 1 << 14
