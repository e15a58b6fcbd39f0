"""Molecules and reactions as Spark data: parsing, matching, hashing and comparison of molecular graphs at scale."""
