"""Retrieval and graph analytics over document collections, declared as DataFrame and SQL plans."""
