"""Data workloads for PySpark: run records, job history, SQL, graph, ML and stream jobs."""
