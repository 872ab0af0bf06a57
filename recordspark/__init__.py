"""Versioned key/time records and JSON documents as Spark DataFrames."""
