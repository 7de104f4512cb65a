"""Ordered rules that name what a task does, as SQL conditions; the first that holds counts."""

from __future__ import annotations

#: Pattern over the upper-case process name, operation, feature classes.
OPERATIONS = (
    (r"KRAKEN2", "KRAKEN2", ("database_lookup", "random_io", "mmap_enabled")),
    (r"(?:^|[_:])(?:UNTAR|UNTAR_DB|UNTAR_KRAKEN2DB)$|UNPACK_DB", "UNTAR", ("decompression", "sequential_io", "mmap_heavy")),
    (r"MERGE_HAPLOTYPECALLER", "MERGE_HAPLOTYPECALLER", ("jvm", "variant_processing", "sequential_io")),
    (r"HAPLOTYPECALLER", "HAPLOTYPECALLER", ("jvm", "compute_heavy", "reference_io")),
    (r"MINIMAP|MAP_WINDOW|BUILD_INDEX", "MINIMAP2", ("alignment", "index_lookup", "mmap_enabled")),
    (r"BWA|ALIGN", "ALIGNMENT", ("alignment", "compute_heavy", "sequential_io")),
    (r"SAMTOOLS|FLAGSTAT|INDEX_BAM", "SAMTOOLS", ("alignment_utility", "sequential_io")),
    (r"FASTQC", "FASTQC", ("quality_control", "sequential_io")),
    (r"FASTP", "FASTP", ("read_preprocessing", "sequential_io")),
    (r"MOSDEPTH", "MOSDEPTH", ("coverage_analysis", "random_io")),
    (r"KRONA", "KRONA", ("report_generation", "metadata_processing")),
    (r"TABIX|BGZIP", "HTSLIB_INDEXING", ("compression", "indexing", "sequential_io")),
)
#: Pattern over the upper-case name with underscores between its words, family.
FAMILIES = (
    (r"DOWNLOAD|FETCH", "download"),
    (r"BUILD_INDEX|_INDEX$", "index_build"),
    (r"ALIGN|MAP_WINDOW|BWAMEM", "alignment"),
    (r"SPLIT|SCATTER|INTERVAL", "partition"),
    (r"INDEX_BAM|INDEX_CRAM", "alignment_index"),
    (r"FLAGSTAT|STATS|FASTQC|MOSDEPTH|MULTIQC", "quality_control"),
    (r"KRAKEN|KAIJU|TAXON", "classification"),
    (r"UNTAR|UNPACK|EXTRACT", "archive_extract"),
    (r"HAPLOTYPE|VARIANT|GATK", "variant_processing"),
    (r"GENERATE|CREATE", "generation"),
)
#: Pattern over the path or address of a staged file, class of its source.
SOURCES = (
    (r"/runs/[^/]+/work/.*/work/stage-|/work/stage-.*/runs/[^/]+/work/", "original"),
    (r"/runs/[^/]+/work/", "intermediate"),
    (r"^(s3|ftp|https|http)://", "external"),
    (r"/work/stage-|^/workflow/(data|source|references)", "original"),
)
UNCLASSIFIED = ("unclassified",)


def first(text: str, rules, value, otherwise: str, like) -> str:
    """A CASE over ``rules``; ``value`` makes an SQL value of a rule, ``like`` an engine's match of a text and a pattern."""
    whens = " ".join(f"when {like(text, rule[0])} then {value(rule)}" for rule in rules)
    return f"case {whens} else {otherwise} end"


def terminal(text: str, engine) -> str:
    """SQL of the last part of a process name, its words joined by underscores; a doubled name once, nothing is UNKNOWN_OPERATION."""
    part = engine.replace_all(f"upper(trim(split_part({text}, ':', -1)))", "[^A-Z0-9]+", "_")
    plain = f"trim(both '_' from {part})"
    half = f"cast(floor(length({plain}) / 2) as int)"
    twice = f"length({plain}) % 2 = 1 and substr({plain}, 1, {half}) = substr({plain}, {half} + 2) and substr({plain}, {half} + 1, 1) = '_' and position('_' in substr({plain}, 1, {half})) = 0 and length({plain}) > 1"
    return f"case when {plain} = '' then 'UNKNOWN_OPERATION' when {twice} then substr({plain}, 1, {half}) else {plain} end"


def underscored(text: str, engine) -> str:
    """SQL of a name in upper case with one underscore between its words and none at its ends."""
    return "trim(both '_' from " + engine.replace_all(f"upper({text})", "[^A-Z0-9]+", "_") + ")"
