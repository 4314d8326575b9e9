"""Operators of a training-data pipeline: extraction, filters, classifiers, dedup, decontamination, packing."""
