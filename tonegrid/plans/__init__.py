"""Registered queries, in groups: each has QUERIES and, where SQL can express them, ORACLE."""

from . import assembly_queries, band_queries, book_queries, coding_queries, config_queries, element_queries, frame_queries, pair_queries, running_queries

GROUPS = (frame_queries, config_queries, band_queries, coding_queries, assembly_queries, element_queries, book_queries, pair_queries, running_queries)
