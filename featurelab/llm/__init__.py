"""Operators for preparing training data: near copies, packing, sharding, private data, search."""
