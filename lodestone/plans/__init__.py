"""Whole jobs: the stages in order, each reading and writing stage tables."""
