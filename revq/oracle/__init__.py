"""The reports in DuckDB SQL, to check the Spark results against."""
