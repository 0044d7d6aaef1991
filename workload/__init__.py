"""Registered queries and the SQL each is checked against."""

from workload import catalogue, matching, search, streams, study, texts, timing

MODULES = (search, catalogue, texts, timing, study, matching, streams)
