"""Re-derivable analytics on Spark: declarative derivations, comparators, invariant checks and verdicts."""
