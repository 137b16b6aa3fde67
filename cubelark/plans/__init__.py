"""Plans: compositions of operators over concrete tables."""
