"""Readers and writers: PLY, raw nodes, metadata, images, synthetic clouds and views of tables."""
