"""A PySpark-native engine for finding recombination events in nucleotide alignments."""
