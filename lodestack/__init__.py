"""Spark-native engine for content-addressed assets: chunking, dedup, manifests, catalogues."""
