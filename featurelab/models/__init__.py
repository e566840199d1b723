"""Learners, cross-validated scoring and stacked model layers."""
