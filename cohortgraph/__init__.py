"""cohortgraph: cohort-of-graphs analytics expressed as Spark DataFrame operators."""
