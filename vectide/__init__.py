"""Vector-set analytics on Spark.

Catalogs of sequences and their embedding vectors, the similarity graph on
those vectors, its clusters, and distances between samples that weight them.
Every operator takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .functions.alignment import align_score
from .operators.align import align_pairs
from .operators.beta import bray_curtis, permanova, permdisp
from .operators.bins import Bins, bin_glom, bin_proteins, plot_bin_similarity
from .operators.components import connected_components
from .operators.differential import bh_adjust, clr, ols_by_group
from .operators.distances import median_sigma, relative_abundance, sample_mmd
from .operators.embedding import embed_proteins
from .operators.ordination import group_hulls, pcoa, plot_pcoa
from .operators.similarity import protein_similarity, significant_pairs, threshold_graph
from .operators.tsne import plot_tsne
from .sources.fasta import read_fasta, write_fasta
from .sources.models import known_models
from .sources.tables import read_counts, read_samples, write_counts

__all__ = [
    "Bins",
    "align_pairs",
    "align_score",
    "bh_adjust",
    "bin_glom",
    "bin_proteins",
    "bray_curtis",
    "clr",
    "connected_components",
    "embed_proteins",
    "group_hulls",
    "known_models",
    "median_sigma",
    "ols_by_group",
    "pcoa",
    "permanova",
    "permdisp",
    "plot_bin_similarity",
    "plot_pcoa",
    "plot_tsne",
    "protein_similarity",
    "read_counts",
    "read_fasta",
    "read_samples",
    "relative_abundance",
    "sample_mmd",
    "significant_pairs",
    "threshold_graph",
    "write_counts",
    "write_fasta",
]
