"""Spark jobs for decision data: mixture preparation, prediction analytics and system comparison."""
