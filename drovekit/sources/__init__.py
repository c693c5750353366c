"""Readers of manifests, labels, features, logs, archives and configurations as DataFrames."""
