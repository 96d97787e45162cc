"""Readers, writers, generators and the mapping of the supplied tables to points and frames."""
