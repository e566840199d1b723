"""Column expressions: portable draws, genomes and name cleaning."""
