"""Every tunable of the analyses, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Mark, stage and chromosome names and their order.
MARKS = ("DNase", "H3K27ac", "H3K27me3", "H3K36me3", "H3K4me1", "H3K4me3", "H3K9ac", "H3K9me3")
STAGES = ("d0", "d7", "d15")
CHROMS = tuple(f"chr{i}" for i in range(1, 23)) + ("chrX",)
PATTERNS = ("000", "111", "001", "110", "011", "100")
ACTIVE_MARKS = ("H3K4me1", "H3K27ac")
REPRESSIVE_MARKS = ("H3K9me3", "H3K27me3")
ZERO_INFLATED_MARKS = ("DNase", "H3K27ac")
STITCH_MARK = "H3K27me3"


@dataclass(frozen=True)
class Params:
    """Defaults of the main analysis; override with ``dataclasses.replace``."""

    bin_size: int = 200
    min_len: int = 2
    main_len: int = 7
    sensitivity_lens: tuple[int, ...] = (4, 5, 7, 9)
    max_cutoff: int = 21
    split_threshold: int = 4000
    split_window: int = 2000
    split_min_tail: int = 1000
    na_impute_frac: float = 0.1
    corr_threshold: float = 0.95
    mfa_ncp: int = 100
    embedding_variance: float = 0.6
    knn_k: int = 40
    resolution: float = 0.4
    seed: int = 518
    grid_variance: tuple[float, ...] = (0.6, 0.7, 0.8)
    grid_resolution: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0)
    grid_k: tuple[int, ...] = (20, 40, 60, 80, 100)
    n_boot: int = 10
    boot_fraction: float = 0.8
    promoter_upstream: int = 2000
    promoter_downstream: int = 2000
    max_tss_distance: int = 200_000
    slice_length: int = 10_000
    slice_window: int = 2000
    control_fold: int = 2
    control_gc: float = 0.02
    control_len: float = 0.10
    burden_alpha: float = 0.5
    max_zero_fraction: float = 0.95
    de_log2fc: float = 0.5
    de_padj: float = 0.05
    go_min_size: int = 10
    go_max_size: int = 300
    go_q: float = 0.05
    ldsc_m: int = 5_961_159
    bucket_width: int = 4096
    scan_width: int = 65_536

    def __post_init__(self) -> None:
        positive = ("bin_size", "min_len", "split_window", "slice_window", "knn_k", "control_fold", "bucket_width", "scan_width")
        if any(getattr(self, name) < 1 for name in positive):
            raise ValueError(f"{', '.join(positive)} must be at least 1")
        if min(self.control_gc, self.control_len, self.max_tss_distance, self.promoter_upstream) < 0:
            raise ValueError("tolerances and distances must not be negative")
        if not 0 < self.boot_fraction <= 1:
            raise ValueError("boot_fraction must be in (0, 1]")


DEFAULTS = Params()
