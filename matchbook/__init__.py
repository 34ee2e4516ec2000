"""matchbook: matched-observation benchmarks and audits as Spark DataFrame jobs."""
