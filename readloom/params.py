"""Parameters of the three programs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PeakParams:
    """Peak calling: fragment length (None: estimate it) and its deviation, strand-shift steps, output limits and modes."""

    fragment_length: int | None = None
    deviation: int = 50
    keep_dup: bool = False
    top_n: int = 100_000
    q_cutoff: float = -1.0
    nexus: bool = False
    shift_steps: int = 1000
    radius: int = 1000
    pseudo_control: bool = False
    drop_last_summit: bool = True

    def __post_init__(self):
        if self.nexus:  # these samples are not deduplicated by position, and their fragments vary little
            object.__setattr__(self, "keep_dup", True)
            object.__setattr__(self, "deviation", 5)

    @property
    def q_min(self) -> int:
        return self.fragment_length - self.deviation

    @property
    def q_max(self) -> int:
        return self.fragment_length + self.deviation

    def with_length(self, n: int) -> PeakParams:
        return replace(self, fragment_length=n)


@dataclass(frozen=True)
class TrimParams:
    """Read preprocessing, stage by stage; None or 0 leaves a stage out."""

    first_reads: int | None = None
    trim_left: int = 0
    trim_right: int = 0
    trim_tag: bool = False
    min_length: int = 0
    uncalled: int | None = None
    substitute: str | None = None
    barcodes: tuple[str, ...] = ()
    approximate: bool = False
    hard_clip: bool = False
    exclude_unidentified: bool = False
    quality: int | None = None
    quality_mode: str = "TAIL"
    quality_min_length: int = 0
    adapters: tuple[str, ...] = ()
    error_rate: float = 0.2
    errors: int | None = None
    non_linear: bool = False
    min_overlap: int = 4
    overhang: int = 0
    times: int = 1
    top_down: bool = False
    by_quality: bool = False
    final_length: int = 0
    tag: bool = True


@dataclass(frozen=True)
class DedupParams:
    """Barcode deduplication of mapped reads."""

    min_unique: int = 0
    chrom_filter: str | None = None
    split: bool = False
    drop_last: bool = False  # as older tools do: the last record of the file is not read
