"""Column functions: dates, paths, truth and text pipelines."""
