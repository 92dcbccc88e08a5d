"""The flagship plan: from reads of two samples to ranked regions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import match_blocks
from ..operators import background, coverage, normalize, peaks, score
from ..operators.staged import drop, staged
from ..sources.reads import full_mappability


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, as a configuration names them."""

    ext: int = 200  # Enrichment_mapped_fragment_length
    fdr: float = 0.05  # target_FDR
    max_q: float = 0.05  # max_Qvalue
    sims: int = 10  # N_Simulations
    gap: int = 200  # Minimum_interpeak_distance
    seed: int = 1234567  # Simulation_seed
    model: str = "Poisson"  # Background_model
    cap: int = 10_000  # copies per position and replicate
    window: int = 1_000_000
    compat: bool = True
    max_threshold: int = peaks.MAX_THRESHOLD  # Max_threshold; a window that needs more is an error


class Run:
    """The stages of one run, each a DataFrame that depends on those it names."""

    def __init__(self, reads: DataFrame, settings: Settings, mappability: DataFrame | None = None):
        self.s = settings
        kept = coverage.prune_duplicates(reads, settings.cap)
        blocks = match_blocks(kept.select("sample", "chrom", "strand", "pos", "cigar"))
        self.fragments = coverage.extend(blocks, settings.ext)
        self._map = mappability
        self._kept: list[DataFrame] = []

    def _tabled(self) -> None:
        """From here on the fragments are a table, as coverage, windows, scaling and counts read them."""
        self.fragments = self._keep(self.fragments, "fragments")

    @property
    def chip(self) -> DataFrame:
        return self.fragments.where("sample = 'chip'")

    @property
    def mappability(self) -> DataFrame:
        return self._map if self._map is not None else full_mappability(self.fragments, self.s.window)

    @property
    def events(self) -> DataFrame:
        return coverage.events(self.chip)

    @property
    def slopes(self) -> DataFrame:
        return normalize.scaling(normalize.bin_counts(self.fragments, compat=False))

    @property
    def reads(self) -> DataFrame:
        return coverage.reads_per_window(self.chip, self.s.window).select("chrom", "win", "n")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table until ``release``, as several stages read it."""
        self._kept.append(staged(df, name))
        return self._kept[-1]

    def release(self) -> None:
        """Deletes the run's tables: results that were not computed before can't be any more."""
        drop(*self._kept)
        self._kept.clear()

    @cached_property
    def profile(self) -> DataFrame:
        """A row per step of the height, read by the peaks and the summits."""
        return self._keep(coverage.profile(self.events), "profile")

    @cached_property
    def all_peaks(self) -> DataFrame:
        """Read by the counts and the regions."""
        return self._keep(peaks.all_threshold_peaks(self.profile, self.s.gap, self.s.max_threshold), "peaks")

    @property
    def counts(self) -> DataFrame:
        return peaks.counts_per_window(self.all_peaks, self.s.window)

    @cached_property
    def thresholds(self) -> DataFrame:
        """A row per window up to each chromosome's end."""
        self._tabled()
        return self._thresholds(self.mappability)

    def _thresholds(self, windows: DataFrame) -> DataFrame:
        s = self.s
        if s.model == "Poisson":
            return self._keep(background.poisson_thresholds(self._keep(self.reads, "reads"), windows, s.ext, s.fdr, s.max_threshold), "thresholds")
        return self._keep(background.simulated_thresholds(self._keep(self.simulated(), "simulated"), self._keep(self.counts, "counts"), windows, s.sims, s.fdr, s.max_threshold), "thresholds")

    def simulated(self) -> DataFrame:
        """Peaks of simulated reads. Only windows that hold reads of the signal are drawn, so without a map no others are made."""
        s, reads = self.s, self._keep(self.reads, "reads")
        windows = self._map if self._map is not None else reads.where("win >= 0").select("chrom", "win", F.lit(s.window).cast("bigint").alias("n_mappable"))
        return background.simulate_windows(reads, windows, s.ext, s.sims, s.seed, s.gap, s.max_threshold)

    @property
    def touched(self) -> DataFrame:
        """The windows that a peak touches, and so all that hold reads of the signal: no other takes part in a region. The peaks at
        1 hold all others. Their number follows the reads, not the length of the chromosomes."""
        s = self.s
        at = self.all_peaks.where("thr = 1").select("chrom", F.explode(F.expr(f"sequence(start div {s.window}, end div {s.window})")).alias("win")).distinct()
        if self._map is not None:
            return self._map.join(at, ["chrom", "win"], "left_semi")
        return at.where("win >= 0").withColumn("n_mappable", F.lit(s.window).cast("bigint"))

    @cached_property
    def regions(self) -> DataFrame:
        """A row per region, read by both counts and the summits."""
        self._tabled()
        return self._keep(peaks.stitch(self.all_peaks, self._thresholds(self._keep(self.touched, "windows")), self.s.gap, self.s.window), "regions")

    @cached_property
    def scores(self) -> DataFrame:
        """Regions with their scores."""
        self._tabled()
        starts = self._keep(self.fragments.groupBy("sample", "chrom", "start").agg(F.count("*").alias("c")), "starts")
        return self._keep(score.score_regions(self.regions, starts, self.slopes, self.s.ext), "scores")

    def scored(self) -> DataFrame:
        return self.scores

    def candidates(self) -> DataFrame:
        """All regions with q and summit."""
        ranked = score.q_values(self.scored())
        tops = score.summits(ranked.select("chrom", "start", "end"), coverage.segments(self.profile))
        return ranked.join(tops, ["chrom", "start", "end"], "left").withColumn("summit", score.summit_offset(self.s.compat))

    def called(self) -> DataFrame:
        return self.candidates().where(F.col("q") < self.s.max_q)
