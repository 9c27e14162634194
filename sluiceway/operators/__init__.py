"""Batch operators; the row-wise ones work on streams as they are."""
