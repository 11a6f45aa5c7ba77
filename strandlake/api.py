"""Four thin classes over DataFrames: genome, map, segments, rare variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coords
from .operators import ibd, rare, stats
from .operators import intervals as I
from .sources import readers


class GInfo:
    """Chromosome names and sizes; aliases must not name two chromosomes."""

    def __init__(self, spark: SparkSession, chromnames: list[str], chromsizes: list[int], aliases: dict[str, int] | None = None):
        if len(set(chromnames)) != len(chromnames):
            raise ValueError("a chromosome name stands twice")
        for alias, k in (aliases or {}).items():
            if not 0 <= k < len(chromnames):
                raise ValueError(f"alias {alias} names no chromosome")
            if alias in chromnames and chromnames.index(alias) != k:
                raise ValueError(f"alias {alias} is the name of another chromosome")
        self.spark = spark
        self.genome = readers.genome_from_lists(spark, chromnames, chromsizes)
        self.aliases = readers.aliases(spark, {**{n: k for k, n in enumerate(chromnames)}, **(aliases or {})})


class GMap:
    """A genetic map of one rate or of knots."""

    def __init__(self, ginfo: GInfo, bp_per_cm: float = 15_000.0, knots: DataFrame | None = None):
        self.knots = readers.constant_map(ginfo.genome, bp_per_cm) if knots is None else knots

    def get_cm(self, df: DataFrame, bp: str) -> DataFrame:
        return coords.bp_to_cm(df, self.knots, bp)

    def get_bp(self, df: DataFrame, cm: str) -> DataFrame:
        return coords.cm_to_bp(df, self.knots, cm)


class IBD:
    """A set of segments (ind1, hap1, ind2, hap2, chrid, s, e)."""

    def __init__(self, segs: DataFrame, ginfo: GInfo):
        self.segs, self.ginfo = ibd.normalize(segs), ginfo

    def get_coverage(self, step: int) -> DataFrame:
        return I.sweep_coverage(I.grid(self.ginfo.genome, step), self.segs, ["chrid"])

    def get_xirs(self, sites: DataFrame, n_pairs: int, min_maf: float = 0.01, method: int = 2) -> DataFrame:
        """(chrid, pos, freq, raw, bin, z, xirs, pval) of sites of which both alleles reach min_maf."""
        kept = sites.where((F.col("freq") >= min_maf) & (F.col("freq") <= 1 - min_maf))
        pairs = self.segs.select((F.col("ind1") * 4 + F.col("hap1")).alias("g1"), (F.col("ind2") * 4 + F.col("hap2")).alias("g2"), "chrid", "s", "e")
        raw = stats.xirs_raw(pairs, kept, n_pairs) if method == 2 else stats.xirs_row_sums(kept)
        return stats.xirs_pvalues(stats.xirs_norm(raw))

    def get_totals(self) -> DataFrame:
        return ibd.pair_totals(self.segs)


class RVar:
    """Rare-variant records (pos, genome, allele), with sites and individuals if given."""

    def __init__(self, rec: DataFrame, sites: DataFrame | None = None, inds: DataFrame | None = None):
        self.rec, self.sites, self.inds = rec, sites, inds

    def _need(self, name: str) -> DataFrame:
        if (df := getattr(self, name)) is None:
            raise ValueError(f"{name} were not given")
        return df

    def get_records(self) -> DataFrame:
        return self.rec

    def get_sites(self) -> DataFrame:
        return self._need("sites")

    def get_inds(self) -> DataFrame:
        return self._need("inds")

    def get_jaccard(self, first: DataFrame | None = None, second: DataFrame | None = None) -> DataFrame:
        """Pairs g1 > g2 of all genomes, or of one of ``first`` (genome) with one of ``second``."""
        if first is None:
            return rare.jaccard(self.rec)
        return rare.jaccard(self.rec, rare.pairs_of_lists(first, second))
