"""Training-data curation on Spark: corrupt, represent, cluster, select, split, re-weight, evaluate."""
