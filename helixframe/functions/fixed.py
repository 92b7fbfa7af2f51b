"""Fixed values that results depend on."""

# Task groups, in display order.
TASK_GROUPS = ["Chromatin profiles", "Genome origin", "Splicing", "Regulatory elements"]

# Metrics of the overall score table.
OVERVIEW_METRICS = ["eval_mcc", "eval_accuracy", "eval_f1_score", "eval_samples_per_second"]

# Display name of each genome-origin dataset.
DATASET_ALIASES = {"plasmid_detection": "Plasmid", "four_kingdoms": "Four kingdom"}

# Label codes of the two genome-origin datasets.
PLASMID_LABELS = {0: "Chromosome", 1: "Plasmid"}
KINGDOM_LABELS = {0: "Virus", 1: "Bacteria", 2: "Eukaryote", 3: "Archaea"}

# Tokens marked in the token map.
HIGHLIGHT_TOKENS = ["aaagaa", "gaagcga", "gacgacca"]

# Continued-training variants in display order, the base last.
VARIANTS = ["Me", "Mp", "Ms", "base"]

# Special token ids and the nucleotide order of the k-mer codes.
PAD, UNK, CLS, SEP, MASK = 0, 1, 2, 3, 4
SPECIAL_COUNT = 5
NUCLEOTIDES = "ACGT"
