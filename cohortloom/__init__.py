"""cohortloom: epidemiology and clinical-validation analytics as Spark DataFrame operations."""
