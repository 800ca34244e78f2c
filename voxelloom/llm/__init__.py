"""Operators of a training-data pipeline: filtering, near copies, search, scoring and mixing."""
